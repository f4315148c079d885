"""Document hygiene and analytics on Spark DataFrames."""
