"""Lodestrata: feature analytics on Spark (schema mapping, CQL2 filters, tiles, change feeds)."""

__version__ = "0.1.0"
