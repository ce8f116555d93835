"""A Spark-native engine for archives, their pages and journals, as DataFrames."""
