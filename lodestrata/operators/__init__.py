"""Operators beyond queries: vector tiles, routing, mutations."""
