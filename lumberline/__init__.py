"""Log cleaning, crash extraction and pattern filtering on Spark DataFrames."""
