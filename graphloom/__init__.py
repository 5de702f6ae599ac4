"""Graphloom: a PySpark-native engine for property graphs of source code and linked data."""
