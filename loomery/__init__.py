"""Spark-native analytics over document corpora: DataFrame in, DataFrame out."""
