"""Dataset curation and evaluation analytics, expressed on Spark DataFrames."""
