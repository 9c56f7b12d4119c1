"""heddle: a PySpark-native engine for screen harmonisation, panel statistics, evaluation and signature search."""
