"""Training-data operators: dedup, filtering, extraction, mixing, packing, search and scoring.

Nothing else in the library imports this subpackage.
"""
