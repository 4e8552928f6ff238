"""A PySpark-native engine for transactional, log-structured Parquet tables."""

VERSION = "0.1"
