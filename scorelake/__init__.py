"""Text-prediction evaluation on Spark DataFrames."""
