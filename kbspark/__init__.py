"""Analytics over document corpora as DataFrame operations."""
