"""hostmill: host-metric analytics on Spark DataFrames."""
