"""chatlake: a Spark-native engine for group-chat and document corpora."""

__version__ = "0.1.0"
