"""Evidence, data-quality and answer-checking operators on Spark DataFrames."""
