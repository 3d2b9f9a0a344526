"""Training-data operators: one module an operator, queries in ``queries.py``, their SQL in ``oracles.py``.

Nothing else in the library imports this subpackage, so it can be removed as a whole.
"""
