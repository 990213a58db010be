"""Screen-layout analytics on Spark: element trees, words, icons and timings as flat DataFrames."""

__version__ = "0.1.0"
