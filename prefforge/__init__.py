"""Prefforge: a PySpark-native engine for preference data and training corpora."""
