"""Panel analytics on daily market bars, written as Spark DataFrame operations."""

__version__ = "0.1.0"
