"""Queries by name, with their SQL; modules of this package register them on import."""

from __future__ import annotations

from codeloom.sources.tables import Graph, with_clause

ENTRIES: dict = {}


def query(sql: str | None, tables: str | None = None):
    """Register a function of a graph, with the SQL for the same rows; ``tables`` names the model's tables it uses."""

    def add(f):
        text = None
        if sql is not None:
            text = (with_clause("sha256", tables.split()) + " " + sql) if tables else sql
        ENTRIES[f.__name__] = (lambda spark, sf_dir: f(Graph(spark, sf_dir)), text)
        return f

    return add
