"""burstlake: a Spark-native engine for complex (I/Q) time-series datasets and their metadata."""

__version__ = "0.1.0"
