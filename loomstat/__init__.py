"""loomstat: statistical and machine-learning operators on Spark DataFrames."""

__version__ = "0.1.0"
