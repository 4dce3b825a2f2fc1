"""Training-data operators: deduplication, formatting, quality, privacy, tokens, mixing, language.

Nothing outside this subpackage imports it; `__spark_entry__.py` adds its
queries when it can be imported.
"""
