"""PySpark-native engine for screening pools of documents."""

__version__ = "0.1.0"
