"""corpusmith: retrieval analytics and corpus processing as DataFrame plans."""

__version__ = "0.1.0"
