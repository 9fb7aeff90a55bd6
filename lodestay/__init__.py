"""A Spark-native engine for rental-listing analytics."""
