"""PySpark-native text retrieval and corpus processing."""
