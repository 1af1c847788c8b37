"""Every registered query, with the SQL that must give the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_utc


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.run(ensure_utc(spark), folder)


def all_queries() -> dict[str, Query]:
    from . import analysis, checks, reading, writing

    found: dict[str, Query] = {}
    for module in (reading, analysis, checks, writing):
        for name, query in module.QUERIES.items():
            if name in found:
                raise KeyError(f"query registered twice: {name}")
            found[name] = query
    return found
