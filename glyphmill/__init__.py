"""Spark-native corpus tokenisation, token analytics and training-math operators."""
