"""corvane: retrieval analytics over text and record collections, on Spark DataFrames."""

__version__ = "0.1.0"
