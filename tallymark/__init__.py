"""tallymark: a PySpark-native analytics engine for text-extraction pipelines."""
