"""A PySpark-native analytics engine for operational knowledge and large text corpora."""
