"""Training-data operators: scoring, filtering, deduplication, mixing and archive output.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its
queries when it is present.
"""
