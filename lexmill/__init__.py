"""lexmill: document search and text analytics as pure PySpark DataFrame transforms."""

__version__ = "0.1.0"
