"""A PySpark-native engine for mining relations, searching records and preparing text."""
