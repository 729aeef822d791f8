"""Sequence analytics on Spark: search, intervals, codecs and readers as DataFrame programs."""

__version__ = "0.1.0"
