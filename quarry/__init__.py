"""Spark-native evidence ranking engine."""
