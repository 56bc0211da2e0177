"""tidewatch: a PySpark-native engine for community discussion signals."""

__version__ = "0.1.0"
