"""Whether a renderer knows the commands of a body: events joined with small, fixed dimension tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from glyphlake.tex import registry as R
from glyphlake.tex.translate import events


@dataclass(frozen=True)
class Profile:
    """A renderer with its loaded packages and the user's macros (name -> number of arguments)."""

    renderer: str = "mathjax-v3"
    packages: frozenset[str] = frozenset()
    macros: dict = field(default_factory=dict)


    def with_package(self, name: str) -> Profile:
        return replace(self, packages=self.packages | {name})

    def with_macro(self, name: str, arguments: int = 0) -> Profile:
        return replace(self, macros={**self.macros, name: arguments})


_KATEX_LACKS = {"eqnarray", "multline", "flalign"}
#: Packages that a renderer has loaded from the start.
BUILT_IN = {"mathjax-v3": frozenset(), "katex": frozenset({"cancel", "color", "braket"})}
_NAMES = sorted(set(R.PACKAGES.values()))


def package_mask(names: set[str] | frozenset[str]) -> int:
    return sum(1 << k for k, n in enumerate(_NAMES) if n in names)


def package_bit(name: Column) -> Column:
    """The bit of a package; 0 if it is null or unknown."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, n in enumerate(_NAMES) for x in (n, 1 << k)]), name), F.lit(0))


def command_events(regions: DataFrame) -> DataFrame:
    """``(doc_id, n, text)``, n the offset of the body -> one row per event: (doc_id, s, e, what, name, in_text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, at, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += [(doc, at + len(text[:a].encode()), at + len(text[:b].encode()), what, name, mode) for what, name, a, b, mode in events(text or "")]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_()]
            columns = zip(*rows, strict=True) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "s", "e", "what", "name", "in_text"])

    return regions.select("doc_id", F.col("n").alias("at"), "text").mapInArrow(run, "doc_id long, s int, e int, what string, name string, in_text boolean")


STRUCTURAL = ("text", "mbox", "textrm", "textbf", "textit", "big", "Big", "bigl", "bigr", "Bigl", "Bigr")


def overlay(spark: SparkSession) -> DataFrame:
    """(name, category, package): every command a renderer knows, once; a fixed table of a few hundred rows."""
    known = {n: (c, R.PACKAGES.get(n)) for n, c in R.CATEGORY.items()} | {n: ("package", p) for n, p in R.PACKAGES.items()} | {n: ("structural", None) for n in STRUCTURAL}
    return spark.createDataFrame([(n, *v) for n, v in sorted(known.items())], "name string, category string, package string")


def classified(rows: DataFrame, profile: Profile | None = None) -> DataFrame:
    """Commands (column ``name``) with their class: macro, structural, package, a registry category, or unsupported.

    The user's macros come first, then structure, then the overlay of packages, then the registry.
    """
    profile = profile or Profile()
    rows = rows.join(F.broadcast(overlay(rows.sparkSession)), "name", "left")
    macro = F.col("name").isin(*profile.macros) if profile.macros else F.lit(False)
    kind = F.when(macro, "macro").when(F.col("category") == "structural", "structural").when(F.col("package").isNotNull(), "package")
    return rows.withColumn("class", kind.otherwise(F.coalesce("category", F.lit("unsupported"))))


def environments_of(profile: Profile) -> list[str]:
    return sorted(set(R.ENVIRONMENTS) - (_KATEX_LACKS if profile.renderer == "katex" else set()))


def issues(regions: DataFrame, profile: Profile | None = None) -> DataFrame:
    """(doc_id, s, e, code, name): unsupported commands and environments, missing packages, math commands in text."""
    profile = profile or Profile()
    rows = classified(command_events(regions), profile)
    lacks = ~F.regexp_replace("name", r"\*$", "").isin(environments_of(profile))
    loaded = package_bit(F.col("package")).bitwiseAND(F.lit(package_mask({*profile.packages, *BUILT_IN[profile.renderer]}))) != 0
    code = (
        F.when(F.col("what") == "exit", None)
        .when(F.col("what") == "enter", F.when(lacks, "unsupported-environment"))
        .when(F.col("class") == "unsupported", "unsupported-command")
        .when((F.col("class") == "package") & ~loaded, "missing-package")
        .when(F.col("in_text") & F.col("class").isin("greek", "operator", "relation", "arrow", "large"), "math-in-text")
    )
    return rows.withColumn("code", code).where("code is not null").select("doc_id", "s", "e", "code", "name")
