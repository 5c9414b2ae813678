"""Spark-native network accessibility, raster-cell and movement analytics."""
