"""Spark-native quality engine for facts drawn from documents."""
