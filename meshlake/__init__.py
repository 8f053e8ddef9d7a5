"""meshlake: a PySpark-native engine for vectors, property graphs, text and JSON payloads."""

__version__ = "0.1.0"
