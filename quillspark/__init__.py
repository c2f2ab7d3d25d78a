"""A PySpark-native engine for document intelligence over line-structured text."""
