"""Spark-native analytics over air-emissions inventories."""
