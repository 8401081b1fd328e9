"""Corvane: a Spark-native engine for searching, citing and cleaning document collections."""
