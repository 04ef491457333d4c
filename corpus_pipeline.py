"""A training-data pipeline over ``documents``: language, near-copies, benchmark leaks, secrets, packing.

Each stage is written as Parquet and read again by the next. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from glyphlake.llm import decontam, langid, packing, secrets, simhash
from glyphlake.llm.common import Workspace, read_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
OTHERS = [c for c in COLUMNS if c != "text"]

#: A text is rejected if it has no letters, or if no language gets this far from chance towards what labelled texts reach.
LEAST_SHARE = 0.15
#: One item whose window occurs is a leak. (The query of its own reports two or more as contaminated.)
LEAST_ITEMS = 1


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in some language. The network is trained on this stage's labelled documents."""
    predictor = langid.train(docs.where(~langid.is_held_out(F.col("doc_id"))))
    found = langid.identify(docs.select(COLUMNS), predictor, OTHERS, text_as="text")
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= predictor.floor(LEAST_SHARE))).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the one with the least id; of rows that repeat it, one."""
    rows = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("_row"))
    groups = simhash.simhash_groups(rows, width=3, bits=2, keep=("_row",))
    stay = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("group").agg(F.min("_row").alias("_row")).select("_row")
    return rows.join(stay, "_row", "left_semi").dropDuplicates(["_row"]).select(COLUMNS)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    found = decontam.contamination(docs.select(COLUMNS), read_table(spark, sf_dir, "benchmark"), width=8, least_items=LEAST_ITEMS, keep=OTHERS, text_as="text")
    return found.where(~F.col("contaminated")).select(COLUMNS)


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets in their texts are replaced by marks, and n_chars follows."""
    found = secrets.scan_secrets(docs.select(COLUMNS), keep=OTHERS)
    chars = F.when(F.col("spans") != "", F.length("clean_text").cast("long")).otherwise(F.col("n_chars"))
    return found.select("doc_id", F.col("clean_text").alias("text"), "lang", "source", chars.alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens and their places in the training sequences."""
    return packing.pack_best_fit(docs.select(COLUMNS), window=1024, tokenizer="byte_bpe_50k", end_id=2)


STAGES = [
    ("language_id", identify_language),
    ("near_copies", drop_near_copies),
    ("benchmark_leaks", drop_benchmark_leaks),
    ("secrets", remove_secrets),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = ws.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
