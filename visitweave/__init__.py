"""Visit analytics for web browsing data on Spark DataFrames."""
