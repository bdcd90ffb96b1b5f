"""Relational operators: routing, joins, keyed history, windowed aggregates, versions."""
