"""Training-data operators: filters, search, scoring, dedup, tokenization.

Nothing outside this subpackage imports it; ``queries.py`` and ``oracle.py``
hold the registered queries and their SQL.
"""
