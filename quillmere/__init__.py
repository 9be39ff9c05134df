"""quillmere: a PySpark-native engine for governed knowledge corpora."""

__version__ = "0.1.0"
