"""alignforge: pairwise local sequence alignment as Spark DataFrames."""

__version__ = "0.1.0"
