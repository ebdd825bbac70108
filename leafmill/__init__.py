"""A batch engine for paged documents on Spark: every page is a row."""

__version__ = "0.2.0"
