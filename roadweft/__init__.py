"""Spark-native road-network analytics: rasters, labels, geometry, graphs, speeds."""
