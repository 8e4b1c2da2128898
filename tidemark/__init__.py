"""Tidemark: a PySpark-native engine for auction-lot analytics and price series."""
