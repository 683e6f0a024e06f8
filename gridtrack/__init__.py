"""Spark-native tracking and statistics of moving objects in gridded snapshots."""
