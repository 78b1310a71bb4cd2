"""Land-cover question analytics on Spark: DataFrame-in, DataFrame-out operators."""
