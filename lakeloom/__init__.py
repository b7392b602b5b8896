"""Lakeloom: a PySpark-native analytics engine over files, databases and change streams."""
