"""Moving-object location analytics on Spark DataFrames."""
