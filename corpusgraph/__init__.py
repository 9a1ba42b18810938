"""A PySpark-native analytics engine for corpora that are text and graph at once."""
