"""Analytics for collectible markets on Spark DataFrames."""
