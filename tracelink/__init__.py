"""Record linkage and volume analytics on Spark DataFrames."""
