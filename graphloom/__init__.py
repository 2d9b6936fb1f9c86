"""Community analytics on evolving graphs, expressed in Spark DataFrames."""

__version__ = "0.1.0"
