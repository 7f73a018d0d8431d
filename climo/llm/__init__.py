"""Training-data operators: quality, privacy, formatting, mixing, deduplication, packing, toxicity.

Nothing outside this subpackage imports it.  ``queries.py`` holds the registered queries and their SQL.
"""
