"""Spark-native analytics for network-shaped data: lines, stations, tours, route pricing and text retrieval."""
