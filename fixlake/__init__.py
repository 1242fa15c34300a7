"""Spark-native analytics over FIX message logs."""
