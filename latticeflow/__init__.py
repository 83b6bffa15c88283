"""Spark-native analytics for weighted three-dimensional point catalogues."""
