"""A Spark-native analytics library: star queries, windows, spatial, hexagonal-grid and raster functions."""
