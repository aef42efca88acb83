"""Tag-driven governance and temporal analytics on Spark DataFrames."""

__version__ = "0.1.0"
