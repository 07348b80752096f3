"""attesta: a source-exact evidence and retrieval engine on Apache Spark DataFrames."""

__version__ = "0.1.0"
