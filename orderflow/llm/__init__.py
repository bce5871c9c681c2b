"""Training-data operators: quality, archives, search, secrets, scoring, dedup, packing and output.

Nothing else in the library imports this subpackage.
"""
