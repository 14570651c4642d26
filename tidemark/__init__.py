"""tidemark: a PySpark-native engine for labelled time series."""

__version__ = "0.1.0"
