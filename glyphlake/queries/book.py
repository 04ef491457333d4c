"""Collections of queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from glyphlake.operators.facts import Facts, located
from glyphlake.operators.fixtures import Expect, Recipe, _lit
from glyphlake.parse.facts import Options

Query = Callable[[SparkSession, str], DataFrame]
Columns = Callable[[], dict[str, Column]]  # made when a query runs: a column needs a session


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document(*slots: tuple[str, str, str]) -> Recipe:
    """Documents of (name, condition, text) slots; the texts are plain, not SQL."""
    return Recipe([(name, cond, _lit(text)) for name, cond, text in slots])


class Book:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def put(f: Query) -> Query:
            self.queries[name] = f
            if sql is not None:
                self.oracle[name] = sql
            return f

        return put

    def fact(self, name: str, fact: str, recipe: Recipe, expects: list[Expect], options: Options | None = None, extra: Columns | None = None, where: str = "true") -> None:
        """Facts of one kind with their places; further columns by name, whose expected values are in ``Expect.extra``."""

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            facts = Facts(recipe.docs(spark, sf_dir), [fact], options)
            rows = located(facts.table(fact).where(where), facts.docs)
            place = [F.col(a).cast("long").alias(b) for a, b in (("line", "line"), ("col", "col"), ("s", "span_start"), ("e", "span_end"))]
            return rows.select("doc_id", F.lit(fact).alias("rule"), *place, *(c.alias(n) for n, c in (extra() if extra else {}).items()))

        self.queries[name], self.oracle[name] = run, f"WITH {recipe.placed()} {recipe.expected(fact, expects)}"

    def column(self, name: str, source: str, columns: Columns, sql: str) -> None:
        """Scalar expressions over one table; ``sql`` is the whole SQL twin."""

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return table(spark, sf_dir, source).select(*[c.alias(n) for n, c in columns().items()])

        self.queries[name], self.oracle[name] = run, sql
