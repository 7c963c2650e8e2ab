"""How a group of queries is registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..packaging import ship
from ..plans.views import WITH, Corpus


class Group:
    """Queries by name, with the SQL that checks each (none: rows only)."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None, corpus: bool = False):
        """Registers f(corpus views) as `name`. corpus: the SQL uses the views of plans.views."""

        def put(f: Callable[[Corpus], DataFrame]):
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                ship(spark)
                return f(Corpus(spark, sf_dir))

            self.queries[name] = run
            if sql:
                self.oracles[name] = f"WITH {WITH.strip()}{',' if sql.lstrip().startswith('+') else ''}\n{sql.lstrip().removeprefix('+')}" if corpus else sql
            return f

        return put


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    """df with columns rounded, -0.0 as 0.0."""
    return df.withColumns({c: clean(F.round(c, digits)) for c in names})


def clean(c: Column) -> Column:
    return c + F.lit(0.0)
