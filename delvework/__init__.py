"""Search, indexing and state tracking over large collections of code and documents, on Spark."""

__version__ = "0.1.0"
