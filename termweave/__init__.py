"""Full-text matching and corpus analytics on Spark DataFrames."""
