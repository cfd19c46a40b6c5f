"""Region, sequence and table analytics on Spark DataFrames."""
