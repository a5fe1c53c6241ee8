"""Spark-native anonymization of tables that mix relational columns with one set-valued column."""
