"""Image tie-point analytics on Spark: DataFrame in, DataFrame out."""
