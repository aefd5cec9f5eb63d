"""Training-data operators: formatting, decontamination, search, sharding, mixing, filtering, packing and deduplication.

Nothing else in the library imports this subpackage; ``queries`` and ``oracle_sql`` live in ``lumenvec.llm.registry``.
"""
