"""Analytics of decentralised-exchange activity on Spark DataFrames."""
