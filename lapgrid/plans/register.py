"""Collects queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixtures


class Register:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def columns(self, name: str, view: str, columns: Callable[[], list[Column]], sql: str, where: str | None = None) -> None:
        """A query that projects one derivation; sql: the select list of the checking query."""

        def run(spark, sf_dir) -> DataFrame:
            df = fixtures.view(spark, sf_dir, view)
            return (df.where(where) if where else df).select(*columns())

        self.queries[name] = run
        self.sql[name] = fixtures.ctes(view) + f" SELECT {sql} FROM {view}" + (f" WHERE {where}" if where else "")

    def query(self, name: str, sql: str | None, *views: str):
        """A decorator for functions of the named derivations (or base tables)."""

        def wrap(f: Callable) -> Callable:
            def run(spark, sf_dir) -> DataFrame:
                return f(*[fixtures.view(spark, sf_dir, v) if v in fixtures.VIEWS else fixtures.table(spark, sf_dir, v) for v in views])

            self.queries[name] = run
            if sql:
                derived = [v for v in views if v in fixtures.VIEWS]
                head = fixtures.ctes(*derived) if derived else "WITH RECURSIVE"
                body = sql.strip()
                self.sql[name] = (head + (",\n " if derived else " ") + body[4:].lstrip()) if body[:4] == "WITH" else (head + "\n" + body if derived else body)
            return f

        return wrap


def r6(c: Column, name: str) -> Column:
    return F.round(c, 6).alias(name)
