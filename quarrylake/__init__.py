"""quarrylake: a PySpark-native engine over text and source-code corpora."""

__version__ = "0.1.0"
