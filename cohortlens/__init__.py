"""Text-cohort analytics on Spark DataFrames."""
