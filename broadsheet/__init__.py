"""Spark-native engine for building auditable datasets from news-style documents."""

__version__ = "0.1.0"
