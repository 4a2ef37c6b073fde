"""A Spark-native analytics engine for technical documents."""
