"""docloom: documents, tables and web pages to model-ready context, on Spark DataFrames."""

__version__ = "0.1.0"
