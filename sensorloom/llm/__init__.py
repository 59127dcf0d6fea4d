"""Training-data operators: filters, near-duplicate search, scoring, mixing, tokenising.

Nothing else in the library imports this subpackage.
"""
