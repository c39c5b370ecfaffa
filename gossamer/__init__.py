"""Page-corpus and link-graph analytics on PySpark."""

__version__ = "0.1.0"
