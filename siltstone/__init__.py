"""Spark-native search, change tracking and storage analytics over large file collections."""
