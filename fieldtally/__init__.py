"""Spark analytics for routine facility reports."""

__version__ = "0.1.0"
