"""Where the modules of queries register them."""

from __future__ import annotations


def registry():
    """(queries, sql, query): two dictionaries by name, and a decorator that adds a function to them under its name."""
    queries, oracle = {}, {}

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                oracle[f.__name__] = sql
            return f

        return add

    return queries, oracle, query
