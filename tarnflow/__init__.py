"""tarnflow: a dataflow analytics engine on Spark DataFrames."""
