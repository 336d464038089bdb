"""A PySpark-native analytics and content-retrieval engine."""
