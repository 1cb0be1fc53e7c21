"""Training-data operators: sharding, token files, deduplication, packing, filters and extraction.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries when it is there.
"""
