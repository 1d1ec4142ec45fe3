"""prlens: a PySpark-native analytics engine for pull-request tables."""
