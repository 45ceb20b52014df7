"""bitloom: a Spark-native engine for preparing, analysing and enriching parallel text."""

__version__ = "0.1.0"
