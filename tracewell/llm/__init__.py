"""Training-data operators: scoring, packing, deduplication, decontamination, filtering, archiving.

Nothing outside this subpackage imports it. Each module holds one operator with its own general
interface; ``queries`` holds the thin ``opN_<name>`` queries that derive the digest columns.
"""
