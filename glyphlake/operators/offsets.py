"""From offsets in canonical text back to the original bytes."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

_REWRITTEN = re.compile(b"\r\n|\0")
_MAP = ArrayType(StructType([StructField("canonical", IntegerType()), StructField("original", IntegerType())]))


@F.pandas_udf(_MAP)
def offset_map(original: pd.Series) -> pd.Series:
    """Where offsets begin to differ: after each CRLF (one byte less) and NUL (two more). Empty if nothing was rewritten."""

    def one(text: str | None) -> list | None:
        if text is None:
            return None
        out, shift = [], 0
        for m in _REWRITTEN.finditer(text.encode()):
            shift += 1 if len(m[0]) == 2 else -2
            out.append({"canonical": m.end() - shift, "original": m.end()})
        return out

    return original.map(one)


def to_original(offsets: Column, at: Column) -> Column:
    """The original byte offset of a canonical one: the last entry at or before it (as-of), or itself."""
    last = F.try_element_at(F.filter(offsets, lambda m: m["canonical"] <= at), F.lit(-1))
    return F.coalesce(at - last["canonical"] + last["original"], at)
