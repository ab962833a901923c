"""Pair-evidence analytics on Spark: DataFrame in, DataFrame out."""
