"""Lynceus: watchlist-screening analytics as Spark DataFrame operations."""
