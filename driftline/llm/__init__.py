"""Training-data operators: quality, deduplication, packing, secrets, mixing, token counts, fingerprints.

Nothing outside this subpackage imports it; ``queries.py`` lists the queries that ``__spark_entry__`` adds.
"""
