"""Issue, usage and notification analytics on Spark DataFrames."""
