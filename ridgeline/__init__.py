"""ridgeline: additive models and corpus operators expressed on Spark DataFrames."""

__version__ = "0.1.0"
