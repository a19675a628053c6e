"""Search-relevance dataset building and retrieval measurement as DataFrame operators."""

__version__ = "0.1.0"
