"""PySpark-native warehouse operators."""
