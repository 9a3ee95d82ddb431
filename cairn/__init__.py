"""Cairn: a PySpark-native engine for file catalogs, byte content and training-data pipelines."""
