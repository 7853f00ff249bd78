"""PySpark-native analytics engine: nearest-neighbour scoring of transactions."""
