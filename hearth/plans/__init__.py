"""Registered queries (``queries.py``) and their DuckDB oracle SQL (``oracles.py``)."""
