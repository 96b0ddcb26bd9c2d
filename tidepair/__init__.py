"""Time-series pair analytics on Spark: DataFrame in, DataFrame out."""
