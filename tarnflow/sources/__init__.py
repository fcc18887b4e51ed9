"""Sources and sinks over Spark's readers and writers."""
