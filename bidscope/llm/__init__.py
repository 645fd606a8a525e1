"""Training-data operators (deduplication, filters, sharding, search, packing).

Nothing outside this subpackage imports it. ``registry`` holds the queries.
"""
