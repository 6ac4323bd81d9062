"""Training-data operators: deduplication, filtering, tokenization, packing, search and quality.

Nothing outside this package imports it. ``registry`` lists the registered queries.
"""
