"""A PySpark-native analytics engine for strictly typed tables, and operators for training corpora."""
