"""A Spark-native engine for component test measurements and corpus preparation."""
