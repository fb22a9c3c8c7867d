"""Training-data operators: search, filtering, de-duplication, tokenizing, sharding, packing.

Nothing outside this package imports it; ``queries.py`` registers one query for each operator.
"""
