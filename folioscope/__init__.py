"""A Spark engine for building, storing and analysing annotations of text collections."""

__version__ = "0.1.0"
