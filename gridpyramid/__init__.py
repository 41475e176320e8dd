"""gridpyramid: a Spark-native engine for gridded products and tile pyramids."""

__version__ = "0.1.0"
