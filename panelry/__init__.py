"""Station-hour panel analytics on Spark: DataFrame in, DataFrame out."""
