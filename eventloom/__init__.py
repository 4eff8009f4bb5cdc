"""eventloom: a PySpark-native event-intelligence engine."""

__version__ = "0.1.0"
