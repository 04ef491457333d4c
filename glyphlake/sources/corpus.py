"""Corpora of Markdown files: scanning, exclusion, admission, joining; and writing them back."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from glyphlake.sources.files import Files

SKIPPED = ("target", "node_modules", ".venv", ".lake", ".ruff_cache", ".pytest_cache", ".cargo")
LIMIT = 10_000_000


def glob_regex(pattern: str) -> str:
    """One gitignore pattern as a regular expression over a path relative to its folder."""
    anchored = pattern.startswith("/") or "/" in pattern.rstrip("/")[:-1]
    body, out, i = pattern.strip("/"), "", 0
    while i < len(body):
        c = body[i]
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := body.find("]", i + 1)) > 0:
            out, i = out + "[" + body[i + 1 : end].replace("!", "^", 1) + "]", end + 1
        else:
            out, i = out + re.escape(c), i + 1
    return ("^" if anchored else "^(?:.*/)?") + out + ("/.*" if pattern.endswith("/") else "(?:/.*)?") + "$"


def excluded(path: Column, patterns: list[str]) -> Column:
    """Whether the last pattern that matches excludes the path; ``!`` takes back, ``#`` is a comment."""
    out = F.lit(False)
    for p in (p.rstrip() for p in patterns):
        if p and not p.startswith("#"):
            out = F.when(path.rlike(glob_regex(p.removeprefix("!"))), F.lit(not p.startswith("!"))).otherwise(out)
    return out


def ignore_file(files: Files, folder: str) -> list[str]:
    """Patterns of .gitignore and .git/info/exclude in a folder."""
    out: list[str] = []
    for name in (".gitignore", ".git/info/exclude"):
        if files.is_file(f"{folder}/{name}"):
            out += files.read(f"{folder}/{name}").splitlines()
    return out


def in_skipped_folder(path: Column) -> Column:
    return path.rlike(rf"(?:^|/)(?:{'|'.join(map(re.escape, SKIPPED))})/")


class MissingRoot(ValueError):
    pass


def scan(spark: SparkSession, roots: list[str], exclude: list[str] = (), ignore: bool = True) -> DataFrame:
    """(path, text): every .md and .markdown file under the roots, once each. A root that is a file yields itself."""
    files, parts = Files(spark), []
    for root in map(files.absolute, roots):
        if not files.exists(root):
            raise MissingRoot(f"no such file or folder: {root}")
        single = files.is_file(root)
        reader = spark.read if single else spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,markdown}")
        rows = reader.text(root, wholetext=True).select(F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/").alias("path"), F.col("value").alias("text"))
        if not single:
            inside = F.substring("path", len(root) + 2, 1 << 30)
            patterns = [*(ignore_file(files, root) if ignore else []), *exclude]
            rows = rows.where(~in_skipped_folder(inside) & ~excluded(inside, patterns))
        parts.append(rows)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.withColumn("path", F.regexp_replace("path", "^file:", ""))
    return out.dropDuplicates(["path"]) if len(parts) > 1 else out


def listed(spark: SparkSession, paths: list[str], fallback: str, more: list[str] = ()) -> DataFrame:
    """The listed files if all are there, else every Markdown file under ``fallback``; and ``more`` files in any case."""
    files = Files(spark)
    roots = list(paths) if paths and all(files.is_file(p) for p in paths) else [fallback]
    return scan(spark, [*roots, *more])


def numbered(files: DataFrame) -> DataFrame:
    """A document id from the path: stable, and no global order is needed."""
    return files.withColumn("doc_id", F.xxhash64("path"))


def admitted(docs: DataFrame, limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """Documents within the size limit (0: none) without control characters, and the others with the reason."""
    too_large = (F.octet_length("text") > limit) if limit else F.lit(False)
    control = F.col("text").rlike(r"[\x00-\x08\x0B\x0E-\x1F]")
    why = F.when(F.col("text").isNull(), "unreadable").when(too_large, "too large").when(control, "control character")
    rows = docs.withColumn("error", why)
    return rows.where("error is null").drop("error"), rows.where("error is not null").drop("text")


def from_text(spark: SparkSession, text: str, path: str = "<stdin>", limit: int = LIMIT) -> DataFrame:
    """One document that was typed or piped in; too large a one is refused."""
    if limit and len(text.encode()) > limit:
        raise ValueError(f"{path}: over {limit} bytes")
    return spark.createDataFrame([(0, path, text)], "doc_id long, path string, text string")


def joined(files: DataFrame, by: str = "path") -> DataFrame:
    """All files as one document, one line break between two. For a preview; the result is one row."""
    rows = files.agg(F.array_sort(F.collect_list(F.struct(by, "text"))).alias("x"))
    return rows.select(F.lit(0).cast("long").alias("doc_id"), F.array_join(F.transform("x", lambda r: F.regexp_replace(r["text"], r"\n$", "")), "\n").alias("text"))


def changed(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, old, new) where the texts differ; a missing text differs from any (full outer join)."""
    a, b = old.select(F.col(key), F.col("text").alias("old")), new.select(F.col(key), F.col("text").alias("new"))
    return a.join(b, key, "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))


def write_back(rows: DataFrame) -> int:
    """Write (path, text) rows to their files, each from the task that holds it; returns how many.

    Only for folders that all executors reach. A task that is run again writes the same bytes to the same file.
    """

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            for path, text in zip(batch["path"], batch["text"], strict=True):
                system, inner = fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else re.sub("^file:/*", "/", path))
                sums = "/.".join(inner.rsplit("/", 1)) + ".crc"  # that Hadoop keeps beside local files; stale after this
                if system.type_name == "local" and system.get_file_info(sums).type == fs.FileType.File:
                    system.delete_file(sums)
                with system.open_output_stream(inner) as file:
                    file.write(text.encode())
            yield pd.DataFrame({"n": [len(batch)]})

    return rows.select("path", "text").mapInPandas(put, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def rewritten(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, text) of the files whose text changes: what an in-place rewrite has to touch."""
    was = old.select("path", F.col("text").alias("_old"))
    return new.join(was, "path").where(~F.col("text").eqNullSafe(F.col("_old"))).select("path", "text")
