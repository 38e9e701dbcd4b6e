"""Shelfwise: a PySpark engine for searching, cleaning and browsing a library of documents."""

__version__ = "0.1.0"
