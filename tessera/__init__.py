"""tessera: a PySpark-native retrieval and corpus analytics engine."""

__version__ = "0.1.0"
