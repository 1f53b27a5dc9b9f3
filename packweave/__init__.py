"""packweave: Spark-first shaping, packing and analysis of text corpora."""

__version__ = "0.1.0"
