"""Training-data operators: dedup, tokens, packing, filters, classifiers.

Nothing else in the library imports this subpackage. ``lodestrata.llm.queries``
registers one query per operator; each module documents its method, its bounds
and what it returns for nulls, empty and very long texts, ties and empty tables.
"""
