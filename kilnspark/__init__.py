"""kilnspark: Spark-native operators for prompt experiments and their text data."""

__version__ = "0.1.0"
