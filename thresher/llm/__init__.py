"""Training-data operators: one module per operator, queries in ``registry``.

Nothing outside this folder imports it; ``registry.QUERIES`` and
``registry.ORACLE_SQL`` are what the driver entry adds.
"""
