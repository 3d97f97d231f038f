"""partloom: a Spark-native engine for catalogue enrichment and corpus preparation."""

__version__ = "0.1.0"
