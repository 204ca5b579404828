"""Training-data operators: packing, scoring, deduplication, filtering and token output.

Nothing else in the library imports this subpackage.
"""
