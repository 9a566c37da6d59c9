"""PySpark-native analytics over change records and text corpora."""
