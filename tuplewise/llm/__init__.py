"""Training-data operators: search, formatting, tokenising, near-duplicates, filters and mixing.

Nothing else in the library imports this subpackage; ``__spark_entry__`` adds its
queries when it is present.
"""
