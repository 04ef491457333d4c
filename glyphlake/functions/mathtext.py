"""Functions of TeX bodies as column expressions; what needs display widths is an Arrow UDF."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from glyphlake.parse.math import ALIGNING, KNOWN


def environment_class(name: Column) -> Column:
    """aligning, plain or custom."""
    return F.when(name.isin(ALIGNING), "aligning").when(name.isin(KNOWN), "plain").otherwise("custom")


def first_unbalanced(body: Column) -> Column:
    """Offset of the first closing brace that nothing opened, 0 if one stays open, null if all match; escaped ones do not count."""
    bare = F.regexp_replace(body, r"(?s)\\.", "  ")  # an escape keeps its length
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(None).cast("int").alias("bad"))

    def step(acc: Column, c: Column) -> Column:
        depth = acc["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        bad = F.coalesce(acc["bad"], F.when(depth < 0, acc["at"]))
        return F.struct((acc["at"] + 1).alias("at"), depth.alias("depth"), bad.alias("bad"))

    end = F.aggregate(F.split(bare, r"(?!\A)(?!\z)"), start, step)
    return F.when(end["bad"].isNotNull(), end["bad"]).when(end["depth"] > 0, 0)


def dollar_form(kind: Column, body: Column, source: Column) -> Column:
    """A region with dollar delimiters; environments stay as they are."""
    inner = F.regexp_replace(body, r"^\s+|\s+$", "")
    return F.when(kind == "display", F.concat(F.lit("$$ "), inner, F.lit(" $$"))).when(kind == "inline", F.concat(F.lit("$"), inner, F.lit("$"))).otherwise(source)


def cells_of(body: Column) -> Column:
    """array<array<string>>: the rows and cells of an aligning environment."""
    rows = F.split(F.regexp_replace(body, r"^\n+|\n+$", ""), r"\\\\")
    return F.transform(rows, lambda r: F.transform(F.split(r, r"(?<!\\)&"), lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")))


@F.pandas_udf(StringType())
def aligned(body: pd.Series) -> pd.Series:
    from glyphlake.fmt.engine import aligned_rows

    return body.map(lambda b: None if b is None else aligned_rows(b))
