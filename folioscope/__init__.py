"""Analytics over document containers and text corpora, built on Spark DataFrames."""

__version__ = "0.1.0"
