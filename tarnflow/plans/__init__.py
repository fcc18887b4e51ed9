"""Driver-managed loops and workloads built from operators."""
