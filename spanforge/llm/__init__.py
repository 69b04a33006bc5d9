"""Training-data operators: deduplication, packing, counting, search, filtering and redaction.

Nothing outside this subpackage imports it; ``queries()`` and ``oracle_sql()`` of
``spanforge.llm.registry`` list what the driver entry file registers.
"""
