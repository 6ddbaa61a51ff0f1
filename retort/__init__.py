"""retort: molecule tables and text corpora as Spark jobs."""

__version__ = "0.1.0"
