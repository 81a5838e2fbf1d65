"""Training-data operators: near-duplicate search, packing, tokenising, extraction, filtering.

Nothing outside this folder imports it; ``__spark_entry__.py`` adds its queries when it is there.
"""
