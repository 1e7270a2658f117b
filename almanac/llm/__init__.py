"""Training-data operators: packing, deduplication, tokenisation, quality, license and language scans.

Nothing else in the library imports this package; ``__spark_entry__`` registers its queries when
it can be imported.
"""
