"""Training-data operators: tokenizing, scoring, fingerprints, filters, sharding and mixing.

Nothing outside this subpackage imports it. Each operator has a general
interface over DataFrames here; ``queries`` holds the thin contract queries.
"""
