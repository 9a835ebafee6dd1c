"""Analytics of source repositories on Spark DataFrames."""
