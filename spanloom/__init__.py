"""spanloom: speech-indexing analytics as declarative Spark plans."""

__version__ = "0.1.0"
