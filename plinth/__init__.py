"""Spark-native columnar analytics: a clustered store, block indexes, and parameterised filter-and-aggregate queries."""
