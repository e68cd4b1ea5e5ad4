"""Training-data operators (tokenising, filtering, deduplication, packing, archives).

Nothing outside this subpackage imports it; ``__spark_entry__.py`` registers its queries when it is present.
"""
