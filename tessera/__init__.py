"""Schema-evolution analytics on Spark DataFrames."""
