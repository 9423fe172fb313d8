"""A Spark-native engine for associative text recall and execution analytics."""
