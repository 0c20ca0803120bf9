"""quillmark: a Spark-first engine that measures and prepares document corpora for retrieval."""

__version__ = "0.1.0"
