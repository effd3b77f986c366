"""A Spark-native engine that turns short text reports into tracked incidents."""
