"""grainmill: a Spark-native engine for feature analysis, feature processing, keyed-parameter learning and data quality."""

__version__ = "0.1.0"
