"""Register of named queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pressroom.functions.text import SPACE, WORD
from pressroom.sources.fixtures import VIEWS_SQL

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = "") -> Callable[[Query], Query]:
    """Register a query; ``sql`` is its twin over the base tables and the named views."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ctes = [VIEWS_SQL[view] for view in views.split()]
            body = sql.strip().replace("@WORD", WORD).replace("@SPACE", SPACE)
            if ctes and body.upper().startswith("WITH "):
                body = ",\n" + body[5:]
            ORACLES[name] = ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body
        return function

    return register
