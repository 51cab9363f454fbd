"""Spark-native evaluation of language-model output in Indic scripts."""

__version__ = "0.1.0"
