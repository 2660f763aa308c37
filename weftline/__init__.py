"""A raster analytics engine on Spark: images as relations of pixels, plus operators for training data."""
