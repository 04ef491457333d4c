"""Joins, aggregates, windows, sorts and sets over positions, on rows derived from the tables by rules both dialects share."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from glyphlake.functions import mathtext as M, text as T
from glyphlake.operators import ranges as R
from glyphlake.operators.facts import Facts, lines_of
from glyphlake.operators.fixtures import Expect, _lit
from glyphlake.queries.book import Book, document, table

BOOK = Book()
QUERIES, ORACLE = BOOK.queries, BOOK.oracle


@dataclass(frozen=True)
class Derived:
    """Rows of a table under a condition, by expressions that read the same in both dialects."""

    source: str
    where: str
    columns: dict[str, str]

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, self.source).where(self.where)
        return rows.selectExpr(*(f"{x.replace('AS VARCHAR', 'AS STRING')} AS {n}" for n, x in self.columns.items()))

    @property
    def sql(self) -> str:
        return f"(SELECT {', '.join(f'{x} AS {n}' for n, x in self.columns.items())} FROM {self.source} WHERE {self.where})"


def _spans(rest: int, step: int, size: str) -> Derived:
    s = f"(p_partkey * {step}) % 997"
    return Derived("part", f"p_partkey % 3 = {rest}", {"doc_id": "CAST(p_partkey % 20 AS BIGINT)", "s": f"CAST({s} AS INTEGER)", "e": f"CAST({s} + {size} AS INTEGER)", "id": "CAST(p_partkey AS BIGINT)", "kind": "CASE WHEN p_partkey % 2 = 0 THEN 'even' ELSE 'odd' END"})


_SMALL, _LARGE = _spans(1, 53, "1 + p_size % 5"), _spans(0, 37, "5 + p_size % 60")
_MARKS = Derived("part", "p_partkey % 3 = 2", {"doc_id": "CAST(p_partkey % 20 AS BIGINT)", "s": "CAST((p_partkey * 71) % 991 AS INTEGER)", "mark": "CAST((p_partkey * 71) % 991 AS INTEGER)"})
_CTE = f"WITH a AS {_SMALL.sql}, b AS {_LARGE.sql}, m AS {_MARKS.sql}"
_LINKS = Derived("part", "p_partkey % 2 = 0", {"doc_id": "CAST(p_partkey % 20 AS BIGINT)", "s": "CAST(p_partkey AS BIGINT)", "label": "'l' || CAST(p_partkey % 9 AS VARCHAR)"})
_DEFS = Derived("part", "p_partkey % 2 = 0 AND p_partkey % 5 < 3", {"doc_id": "CAST((p_partkey * 3) % 20 AS BIGINT)", "s": "CAST(p_partkey AS BIGINT)", "label": "'l' || CAST(p_partkey % 7 AS VARCHAR)", "target": "'/' || CAST(p_partkey AS VARCHAR)"})
_REFS = f"WITH l AS {_LINKS.sql}, d AS {_DEFS.sql}, f AS (SELECT doc_id, label, arg_min(target, s) AS target FROM d GROUP BY doc_id, label)"


@BOOK.add("join01_label_target", f"{_REFS} SELECT l.doc_id, l.s, l.label, f.target FROM l JOIN f ON l.doc_id = f.doc_id AND l.label = f.label")
def join01(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = R.first_wins(_DEFS.frame(spark, sf_dir), ["doc_id", "label"], "target")
    return _LINKS.frame(spark, sf_dir).join(first, ["doc_id", "label"])


@BOOK.add("join02_anti", f"{_REFS} SELECT l.doc_id, l.s, l.label FROM l WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.doc_id = l.doc_id AND d.label = l.label)")
def join02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _LINKS.frame(spark, sf_dir).join(_DEFS.frame(spark, sf_dir), ["doc_id", "label"], "left_anti")


@BOOK.add("join03_semi", f"{_REFS} SELECT l.doc_id, l.s, l.label FROM l WHERE EXISTS (SELECT 1 FROM d WHERE d.doc_id = l.doc_id AND d.label = l.label)")
def join03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _LINKS.frame(spark, sf_dir).join(_DEFS.frame(spark, sf_dir), ["doc_id", "label"], "left_semi")


_NAMES = "alpha beta nosuch leq".split()
_NAMED = Derived("part", "TRUE", {"doc_id": "CAST(p_partkey AS BIGINT)", "name": f"CASE p_partkey % 4 {' '.join(f'WHEN {k} THEN {n!r}' for k, n in enumerate(_NAMES))} END"})


@BOOK.add("join04_left_lookup", f"SELECT doc_id, name, CASE name WHEN 'alpha' THEN 'α' WHEN 'beta' THEN 'β' WHEN 'leq' THEN '≤' END AS symbol FROM {_NAMED.sql}")
def join04(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphlake.tex.registry import commands

    symbols = commands(spark).select("name", "symbol")
    return _NAMED.frame(spark, sf_dir).join(F.broadcast(symbols), "name", "left")


for _key, _how, _test in (("join05_overlap_anti", "overlap", "a.s < b.e AND b.s < a.e"), ("join06_containment_anti", "inside", "b.s <= a.s AND a.e <= b.e"), ("join07_point_anti", "start", "b.s <= a.s AND a.s < b.e")):

    def _outside(spark: SparkSession, sf_dir: str, how: str = _how) -> DataFrame:
        return R.outside(_SMALL.frame(spark, sf_dir), _LARGE.frame(spark, sf_dir), how).select("doc_id", "s", "e", "id")

    BOOK.add(_key, f"{_CTE} SELECT doc_id, s, e, id FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = a.doc_id AND {_test})")(_outside)


@BOOK.add("join08_as_of_backward", f"{_CTE} SELECT doc_id, id, coalesce((SELECT max(m.mark) FROM m WHERE m.doc_id = a.doc_id AND m.s <= a.s), -1) AS mark FROM a")
def join08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.as_of(_SMALL.frame(spark, sf_dir), _MARKS.frame(spark, sf_dir), "mark").select("doc_id", "id", F.coalesce("mark", F.lit(-1)).alias("mark"))


@BOOK.add(
    "join09_snap_both_ways",
    f"{_CTE} SELECT doc_id, id, coalesce((SELECT max(m.s) FROM m WHERE m.doc_id = a.doc_id AND m.s <= a.s), -1) AS lo, coalesce((SELECT min(m.s) FROM m WHERE m.doc_id = a.doc_id AND m.s >= a.e), -1) AS hi FROM a",
)
def join09(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.snapped(_SMALL.frame(spark, sf_dir), _MARKS.frame(spark, sf_dir))
    return rows.select("doc_id", "id", F.coalesce("lo", F.lit(-1)).alias("lo"), F.coalesce("hi", F.lit(-1)).alias("hi"))


_NEXT = "lead(s) OVER (PARTITION BY doc_id ORDER BY s, e)"


@BOOK.add("join10_adjacent_pairs", f"{_CTE} SELECT doc_id, id, coalesce({_NEXT} - e, 0) AS gap, coalesce({_NEXT} < e, FALSE) AS overlaps FROM b")
def join10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.neighbours(_LARGE.frame(spark, sf_dir), ("id",)).select("doc_id", "id", F.coalesce("gap", F.lit(0)).alias("gap"), "overlaps")


_GROUPS = document(("t", "p_partkey % 2 = 0", "- a\n- b\n\n"), ("l", "p_partkey % 3 = 0", "+ a\n\n+ b\n\n"), ("end", "TRUE", "Fin.\n"))


@BOOK.add("join11_position_key", f"WITH {_GROUPS.placed()} SELECT CAST(p_partkey AS BIGINT) AS doc_id, CAST(o_t AS INTEGER) AS s, 2 AS items, 'tight' AS tightness FROM o WHERE p_partkey % 2 = 0 UNION ALL SELECT CAST(p_partkey AS BIGINT), CAST(o_l AS INTEGER), 2, 'loose' FROM o WHERE p_partkey % 3 = 0")
def join11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List groups and tree nodes meet on where they start."""
    facts = Facts(_GROUPS.docs(spark, sf_dir), ["list_groups", "tree"], share=True)
    lists = facts.table("tree").where("kind = 'list'").select("doc_id", "s")
    return facts.table("list_groups").select("doc_id", "s", F.col("n").alias("items"), F.col("text").alias("tightness")).join(lists, ["doc_id", "s"])


@BOOK.add("join12_containment_semi", f"{_CTE} SELECT doc_id, id FROM a WHERE EXISTS (SELECT 1 FROM b WHERE b.doc_id = a.doc_id AND b.s <= a.s AND a.e <= b.e)")
def join12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.within(_SMALL.frame(spark, sf_dir), _LARGE.frame(spark, sf_dir)).select("doc_id", "id")


_PACKED = "ce cancel alpha ket".split()
_OVERLAID = Derived("part", "TRUE", {"doc_id": "CAST(p_partkey AS BIGINT)", "name": f"CASE p_partkey % 4 {' '.join(f'WHEN {k} THEN {n!r}' for k, n in enumerate(_PACKED))} END"})


@BOOK.add("join13_overlay_lookup", f"SELECT doc_id, name, CASE name WHEN 'ce' THEN 'mhchem' WHEN 'cancel' THEN 'cancel' ELSE 'braket' END AS package FROM {_OVERLAID.sql} WHERE name <> 'alpha'")
def join13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphlake.tex.render import overlay

    return _OVERLAID.frame(spark, sf_dir).join(F.broadcast(overlay(spark).select("name", "package")), "name").where("package is not null")


@BOOK.add("join14_cursor_overlap", f"{_CTE} SELECT doc_id, id FROM b WHERE s <= 400 AND e >= 300")
def join14(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphlake.streaming.editing import actions

    found = _LARGE.frame(spark, sf_dir).select("doc_id", "id", F.col("s").alias("span_start"), F.col("e").alias("span_end"), F.lit("").alias("replacement"), F.lit(True).alias("safe"))
    return actions(found, 300, 400).select("doc_id", "id")


# Aggregates


@BOOK.add("agg02_format_outcome", "SELECT count(*) FILTER (WHERE p_partkey % 18 = 0) AS n_changed, CAST(0 AS BIGINT) AS n_divergent, CAST(0 AS BIGINT) AS n_parse_errors FROM part")
def agg02(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphlake.fmt.engine import formatted
    from glyphlake.operators.fixtures import markdown_docs

    rows = formatted(markdown_docs(spark, sf_dir), check=True)
    return rows.agg(F.count_if("changed").alias("n_changed"), F.count_if(F.col("converged") & ~F.col("stable")).alias("n_divergent"), F.count_if(~F.col("converged")).alias("n_parse_errors"))


_TABLE = document(("t", "p_partkey % 2 = 0", "| a | 漢字x |\n|---------|---|\n| longer | b |\n\n"), ("end", "TRUE", "Fin.\n"))


@BOOK.add("agg05_column_widths", "SELECT CAST(p_partkey AS BIGINT) AS doc_id, unnest([0, 1]) AS col, unnest([6, 5]) AS width FROM part WHERE p_partkey % 2 = 0")
def agg05(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = Facts(_TABLE.docs(spark, sf_dir), ["table_cells"]).table("table_cells").where("n <> 1")
    return cells.groupBy("doc_id", F.col("label").cast("int").alias("col")).agg(F.greatest(F.lit(3), F.max(T.display_width("text"))).alias("width"))


_BODY = r"CASE WHEN p_partkey % 2 = 0 THEN 'a & bcd ' || chr(92) || chr(92) || ' efg' ELSE 'x' || chr(92) || '& & y & z' END"
_ROWS = Derived("part", "TRUE", {"doc_id": "CAST(p_partkey AS BIGINT)", "body": _BODY})


@BOOK.add("agg06_aligned_cell_widths", "SELECT CAST(p_partkey AS BIGINT) AS doc_id, unnest(CASE WHEN p_partkey % 2 = 0 THEN [0, 1] ELSE [0, 1, 2] END) AS col, unnest(CASE WHEN p_partkey % 2 = 0 THEN [3, 3] ELSE [3, 1, 1] END) AS width FROM part")
def agg06(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ROWS.frame(spark, sf_dir).select("doc_id", F.explode(M.cells_of(F.col("body"))).alias("row"))
    cells = rows.select("doc_id", F.posexplode("row").alias("col", "cell"))
    return cells.groupBy("doc_id", "col").agg(F.max(T.display_width("cell")).alias("width"))


@BOOK.add("agg07_most_columns", "SELECT CAST(p_partkey AS BIGINT) AS doc_id, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 3 END AS columns FROM part")
def agg07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ROWS.frame(spark, sf_dir).select("doc_id", F.array_max(F.transform(M.cells_of(F.col("body")), F.size)).alias("columns"))


_PATHS = Derived("part", "TRUE", {"path": "'d' || CAST(p_partkey % 5 AS VARCHAR) || '/f' || CAST(p_partkey % 37 AS VARCHAR) || '.md'", "rule": "p_type"})


@BOOK.add("agg08_distinct", f"SELECT count(DISTINCT path) AS n_files, count(DISTINCT rule) AS n_rules FROM {_PATHS.sql}")
def agg08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _PATHS.frame(spark, sf_dir).agg(F.count_distinct("path").alias("n_files"), F.count_distinct("rule").alias("n_rules"))


@BOOK.add("agg09_first_wins", f"{_REFS} SELECT doc_id, label, target FROM f")
def agg09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.first_wins(_DEFS.frame(spark, sf_dir), ["doc_id", "label"], "target")


@BOOK.add("agg10_duplicates", f"{_REFS} SELECT doc_id, count(*) - count(DISTINCT label) AS duplicates FROM d GROUP BY doc_id")
def agg10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _DEFS.frame(spark, sf_dir).groupBy("doc_id").agg((F.count(F.lit(1)) - F.count_distinct("label")).alias("duplicates"))


@BOOK.add("agg11_quantifiers", f"{_CTE} SELECT doc_id, bool_or(e - s > 60) AS any_long, bool_and(s < 990) AS all_early FROM b GROUP BY doc_id")
def agg11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _LARGE.frame(spark, sf_dir).groupBy("doc_id").agg(F.bool_or(F.expr("e - s > 60")).alias("any_long"), F.every(F.expr("s < 990")).alias("all_early"))


@BOOK.add("agg12_best_above_threshold", "SELECT n_name AS name, arg_max(r_name, (jaro_winkler_similarity(n_name, r_name), r_name)) AS nearest FROM nation, region WHERE jaro_winkler_similarity(n_name, r_name) >= 0.5 GROUP BY n_name")
def agg12(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = F.broadcast(table(spark, sf_dir, "region").agg(F.collect_set("r_name").alias("all")))  # five rows, a fixed table
    rows = table(spark, sf_dir, "nation").join(regions).select(F.col("n_name").alias("name"), F.explode("all").alias("r_name")).withColumn("score", T.similarity("name", "r_name"))
    return rows.where("score >= 0.5").groupBy("name").agg(F.max_by(F.col("r_name"), F.struct("score", "r_name")).alias("nearest"))


@BOOK.add("agg13_deepest_cover", f"{_CTE} SELECT a.doc_id, a.id, arg_max(b.id, (b.s, b.id)) AS owner FROM a JOIN b ON a.doc_id = b.doc_id AND b.s <= a.s AND a.s < b.e GROUP BY a.doc_id, a.id")
def agg13(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _SMALL.frame(spark, sf_dir).select("doc_id", "s", "e", "id")
    return R.deepest(points, _LARGE.frame(spark, sf_dir).withColumnRenamed("id", "owner"), "owner").select("doc_id", "id", "owner")


@BOOK.add(
    "agg14_least_squared_slack",
    """WITH RECURSIVE w AS (SELECT CAST(p_partkey AS BIGINT) AS doc_id, string_split(p_name || ' of ' || p_type, ' ') AS ws FROM part WHERE p_partkey % 10 = 0),
    c AS (SELECT doc_id, ws, 0 AS j, CAST(0 AS BIGINT) AS cost FROM w UNION ALL
      SELECT doc_id, ws, k, cost + CASE WHEN k = len(ws) THEN 0 ELSE slack * slack END FROM (
        SELECT doc_id, ws, cost, k, 24 - length(array_to_string(ws[j+1:k], ' ')) AS slack FROM (SELECT doc_id, ws, cost, j, unnest(range(j + 1, len(ws) + 1)) AS k FROM c WHERE j < len(ws))) WHERE slack >= 0)
    SELECT doc_id, CAST(min(cost) AS BIGINT) AS cost FROM c WHERE j = len(ws) GROUP BY doc_id""",
)
def agg14(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphlake.fmt.engine import filled

    rows = table(spark, sf_dir, "part").where("p_partkey % 10 = 0").select(F.col("p_partkey").cast("long").alias("doc_id"), filled(F.concat("p_name", F.lit(" of "), "p_type"), F.lit(24), F.lit("balanced")).alias("lines"))
    slack = F.transform(F.slice("lines", F.lit(1), F.size("lines") - 1), lambda x: (24 - F.length(x)) * (24 - F.length(x)))
    return rows.select("doc_id", F.aggregate(slack, F.lit(0).cast("long"), lambda a, x: a + x).alias("cost"))


@BOOK.add("agg16_ordered_collect", f"{_CTE} SELECT doc_id, string_agg(kind, ',' ORDER BY s, id) AS kinds FROM b GROUP BY doc_id")
def agg16(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _LARGE.frame(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("s", "id", "kind"))).alias("x"))
    return rows.select("doc_id", F.array_join("x.kind", ",").alias("kinds"))


@BOOK.add(
    "agg17_quality_report",
    "SELECT CASE WHEN strlen(text) < 1000 THEN 'small' WHEN strlen(text) < 10000 THEN 'medium' ELSE 'large' END AS bucket, count(*) AS n, CAST(max(strlen(text)) AS BIGINT) AS largest, arg_max(doc_id, (strlen(text), -doc_id)) AS largest_id FROM documents WHERE text IS NOT NULL GROUP BY bucket",
)
def agg17(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.octet_length("text")
    bucket = F.when(size < 1000, "small").when(size < 10000, "medium").otherwise("large")
    rows = table(spark, sf_dir, "documents").where("text is not null").groupBy(bucket.alias("bucket"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.max(size).cast("long").alias("largest"), F.max_by("doc_id", F.struct(size, -F.col("doc_id"))).alias("largest_id"))


# Windows

@BOOK.add("win01_running_offsets", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents WHERE text <> '') SELECT doc_id, CAST(line AS INTEGER) AS line, CAST(coalesce(sum(strlen(t) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM l")
def win01(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("k", "t"))
    before = W.partitionBy("doc_id").orderBy("k").rowsBetween(W.unboundedPreceding, -1)
    return rows.select("doc_id", (F.col("k") + 1).alias("line"), F.coalesce(F.sum(F.octet_length("t") + 1).over(before), F.lit(0)).cast("long").alias("s"))


_HEADS = Derived("part", "TRUE", {"doc_id": "CAST(p_partkey % 40 AS BIGINT)", "s": "CAST(p_partkey AS BIGINT)", "level": "CAST(1 + (p_partkey * 7 + p_size) % 6 AS INTEGER)", "text": "'h' || CAST(p_partkey AS VARCHAR)"})


@BOOK.add("win02_nearest_open_heading", f"WITH h AS {_HEADS.sql} SELECT doc_id, s, level, coalesce((SELECT arg_max(x.text, x.s) FROM h x WHERE x.doc_id = h.doc_id AND x.s < h.s AND x.level < h.level), '') AS parent FROM h")
def win02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.under_heading(_HEADS.frame(spark, sf_dir)).select("doc_id", "s", "level", "parent")


@BOOK.add("win03_occurrence_number", f"{_REFS} SELECT doc_id, label, s, row_number() OVER (PARTITION BY doc_id, label ORDER BY s) AS k FROM d")
def win03(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphlake.operators.facts import occurrence

    return _DEFS.frame(spark, sf_dir).select("doc_id", "label", "s", occurrence("doc_id", "label").cast("long").alias("k"))


@BOOK.add("win04_first_value", f"{_CTE} SELECT doc_id, id, first_value(kind) OVER (PARTITION BY doc_id ORDER BY s, id) <> kind AS differs FROM b")
def win04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _LARGE.frame(spark, sf_dir).select("doc_id", "id", (F.first("kind").over(W.partitionBy("doc_id").orderBy("s", "id")) != F.col("kind")).alias("differs"))


@BOOK.add("win05_lag_lead", f"{_CTE} SELECT doc_id, id, coalesce(lag(id) OVER w, -1) AS before, coalesce(lead(id) OVER w, -1) AS after FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY s, id)")
def win05(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("doc_id").orderBy("s", "id")
    return _LARGE.frame(spark, sf_dir).select("doc_id", "id", F.coalesce(F.lag("id").over(w), F.lit(-1)).alias("before"), F.coalesce(F.lead("id").over(w), F.lit(-1)).alias("after"))


_EVENTS = "SELECT doc_id, s, id AS ord, 1 AS step FROM b UNION ALL SELECT doc_id, e, id + 1000000, -1 FROM b"


@BOOK.add("win06_nesting_depth", f"{_CTE}, v AS ({_EVENTS}) SELECT doc_id, s, ord, CAST(sum(step) OVER (PARTITION BY doc_id ORDER BY s, ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS depth FROM v")
def win06(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _LARGE.frame(spark, sf_dir)
    events = b.select("doc_id", "s", F.col("id").alias("ord"), F.lit(1).alias("step")).unionByName(b.select("doc_id", F.col("e").alias("s"), (F.col("id") + 1000000).alias("ord"), F.lit(-1).alias("step")))
    return R.depth(events).select("doc_id", "s", "ord", "depth")


_SWITCH = Derived("part", "TRUE", {"doc_id": "CAST(p_partkey % 20 AS BIGINT)", "s": "CAST(p_partkey AS BIGINT)", "kind": "CASE WHEN p_size % 3 = 0 THEN 'enable' ELSE 'disable' END"})


@BOOK.add("win07_next_close", f"WITH x AS {_SWITCH.sql} SELECT doc_id, s, coalesce((SELECT min(y.s) FROM x y WHERE y.doc_id = x.doc_id AND y.s > x.s AND y.kind = 'enable'), -1) AS close FROM x WHERE kind = 'disable'")
def win07(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.next_close(_SWITCH.frame(spark, sf_dir), F.col("kind") == "enable").where("kind = 'disable'")
    return rows.select("doc_id", "s", F.coalesce("close", F.lit(-1)).alias("close"))


_ORDERED = document(("ol", "p_partkey % 2 = 0", "3. c\n7. d\n9. e\n\n"), ("end", "TRUE", "Fin.\n"))


@BOOK.add("win08_list_ordinals", "SELECT CAST(p_partkey AS BIGINT) AS doc_id, unnest(['3.', '7.', '9.']) AS marker, unnest([0, 1, 2]) AS ordinal FROM part WHERE p_partkey % 2 = 0")
def win08(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = Facts(_ORDERED.docs(spark, sf_dir), ["list_items"]).table("list_items")
    return items.select("doc_id", F.col("text").alias("marker"), (F.row_number().over(W.partitionBy("doc_id", "label").orderBy("s")) - 1).alias("ordinal"))


_EDITS = Derived("part", "p_partkey % 3 = 0", {"doc_id": "CAST(p_partkey % 20 AS BIGINT)", "s": "CAST((p_partkey * 37) % 997 AS INTEGER)", "e": "CAST((p_partkey * 37) % 997 + 5 + p_size % 60 AS INTEGER)", "ord": "CAST(p_partkey AS INTEGER)", "r": "'x'"})


@BOOK.add(
    "win09_greedy_non_overlap",
    f"""WITH RECURSIVE b AS {_EDITS.sql}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, ord) AS k FROM b),
    g AS (SELECT doc_id, CAST(0 AS BIGINT) AS k, CAST(2147483647 AS BIGINT) AS last, FALSE AS taken, 0 AS ord FROM (SELECT DISTINCT doc_id FROM b) UNION ALL
      SELECT n.doc_id, n.k, CASE WHEN n.e <= g.last THEN n.s ELSE g.last END, n.e <= g.last, n.ord FROM g JOIN n ON n.doc_id = g.doc_id AND n.k = g.k + 1)
    SELECT doc_id, ord FROM g WHERE taken""",
)
def win09(spark: SparkSession, sf_dir: str) -> DataFrame:
    edits = _EDITS.frame(spark, sf_dir).groupBy("doc_id").agg(F.collect_list(F.struct("s", "ord", "e", "r")).alias("edits"))
    return edits.select("doc_id", F.explode(T.greedy_from_the_end(F.col("edits"))).alias("x")).select("doc_id", "x.ord")


_BLANKS = document(("a", "p_partkey % 2 = 0", "one\n\n\n\ntwo\n \n"), ("b", "p_partkey % 3 = 0", "x\n\n"), ("end", "TRUE", "Fin.\n"))


@BOOK.add("win10_blank_runs", f"WITH {_BLANKS.placed()} SELECT CAST(p_partkey AS BIGINT) AS doc_id, CAST(l_a + 1 AS INTEGER) AS first, CAST(l_a + 3 AS INTEGER) AS last FROM o WHERE p_partkey % 2 = 0 UNION ALL SELECT CAST(p_partkey AS BIGINT), CAST(l_a + 5 AS INTEGER), CAST(l_a + 5 AS INTEGER) FROM o WHERE p_partkey % 2 = 0 UNION ALL SELECT CAST(p_partkey AS BIGINT), CAST(l_b + 1 AS INTEGER), CAST(l_b + 1 AS INTEGER) FROM o WHERE p_partkey % 3 = 0")
def win10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.islands(lines_of(_BLANKS.docs(spark, sf_dir)), F.col("text").rlike(r"^[ \t]*$"))


# Sorts


@BOOK.add("srt01_findings_in_order", f"{_CTE} SELECT doc_id, id, row_number() OVER (PARTITION BY doc_id ORDER BY s // 100, s % 100, kind, e, id) AS k FROM b")
def srt01(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphlake.rules.run import ordinal

    found = _LARGE.frame(spark, sf_dir).select("doc_id", "id", F.expr("s div 100").alias("line"), F.expr("s % 100").alias("col"), F.col("kind").alias("rule"), F.col("e").alias("span_end"))
    return found.select("doc_id", "id", ordinal("id").cast("long").alias("k"))


@BOOK.add("srt02_files_by_path", f"SELECT DISTINCT path FROM {_PATHS.sql} ORDER BY path")
def srt02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _PATHS.frame(spark, sf_dir).select("path").distinct().orderBy("path")


@BOOK.add("srt03_edit_order", f"WITH b AS {_EDITS.sql} SELECT doc_id, string_agg(CAST(ord AS VARCHAR), ',' ORDER BY s, e, ord) AS ascending, string_agg(CAST(ord AS VARCHAR), ',' ORDER BY s DESC, ord) AS descending FROM b GROUP BY doc_id")
def srt03(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _EDITS.frame(spark, sf_dir).groupBy("doc_id").agg(F.collect_list(F.struct("s", "e", "ord")).alias("x"))
    down = F.array_sort("x", lambda a, b: F.when(a["s"] != b["s"], b["s"] - a["s"]).otherwise(a["ord"] - b["ord"]))
    names = lambda x: F.array_join(F.transform(x, lambda r: r["ord"].cast("string")), ",")
    return rows.select("doc_id", names(F.array_sort("x")).alias("ascending"), names(down).alias("descending"))


@BOOK.add("srt04_ranges_by_start", f"{_CTE} SELECT doc_id, min((s, e, id)).id AS first_id, max((s, e, id)).id AS last_id FROM b GROUP BY doc_id".replace("min((s, e, id)).id", "arg_min(id, (s, e, id))").replace("max((s, e, id)).id", "arg_max(id, (s, e, id))"))
def srt04(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _LARGE.frame(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("s", "e", "id"))).alias("x"))
    return rows.select("doc_id", F.element_at("x", 1)["id"].alias("first_id"), F.element_at("x", -1)["id"].alias("last_id"))


_PAIRS = Derived("part", "TRUE", {"doc_id": "CAST(p_partkey AS BIGINT)", "a": "p_name || ' end'", "b": "CASE WHEN p_partkey % 3 = 0 THEN p_name || ' stop' ELSE p_name || ' end' END"})


@BOOK.add("srt05_first_divergence", f"SELECT doc_id, CAST(len(string_split(a, ' ')) - 1 AS INTEGER) AS at, 'end' AS old, 'stop' AS new FROM {_PAIRS.sql} WHERE a <> b")
def srt05(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _PAIRS.frame(spark, sf_dir).select("doc_id", T.first_difference(F.split("a", " "), F.split("b", " ")).alias("d")).where("d is not null")
    return rows.select("doc_id", "d.at", "d.old", "d.new")


_TYPOS = "bear-url heading-punctuatoin zzz stray-dolar".split()


@BOOK.add("srt06_best_suggestion", "SELECT unnest(['bear-url', 'heading-punctuatoin', 'zzz', 'stray-dolar']) AS name, unnest(['bare-url', 'heading-punctuation', '', 'stray-dollar']) AS nearest")
def srt06(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphlake.rules.run import suggestions

    return suggestions(spark.createDataFrame([(n,) for n in _TYPOS], "name string")).select("name", F.coalesce("nearest", F.lit("")).alias("nearest"))


_FAMILY = Derived("part", "TRUE", {"doc_id": "CAST(p_partkey % 50 AS BIGINT)", "family": "CASE p_size % 4 WHEN 0 THEN 'tables' WHEN 1 THEN 'italic' WHEN 2 THEN 'strong' ELSE 'references' END"})


@BOOK.add("srt07_first_family", f"SELECT doc_id, arg_min(family, CASE family WHEN 'italic' THEN 1 WHEN 'strong' THEN 2 WHEN 'references' THEN 3 ELSE 4 END) AS family FROM {_FAMILY.sql} GROUP BY doc_id")
def srt07(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphlake.fmt.engine import FAMILIES

    order = F.array_position(F.array(*map(F.lit, FAMILIES)), F.col("family"))
    return _FAMILY.frame(spark, sf_dir).groupBy("doc_id").agg(F.min_by("family", order).alias("family"))


# Sets


@BOOK.add("set01_union_all", f"{_CTE} SELECT kind, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM b) GROUP BY kind")
def set01(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _SMALL.frame(spark, sf_dir), _LARGE.frame(spark, sf_dir)
    return a.unionByName(b).unionByName(b).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


_BOTH = document(("p", "p_partkey % 2 = 0", "Val x*y and `u*v` here.\n\n"), ("end", "TRUE", "Fin.\n"))


@BOOK.add("set02_prose_and_code", "SELECT CAST(p_partkey AS BIGINT) AS doc_id, unnest([4, 13]) AS s, unnest(['x*y', 'u*v']) AS m FROM part WHERE p_partkey % 2 = 0")
def set02(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphlake.rules.stdlib import in_text

    facts = Facts(_BOTH.docs(spark, sf_dir), ["prose", "inline_codes"], share=True)
    return in_text(facts, "prose", r"[A-Za-z]\*[A-Za-z{]").unionByName(in_text(facts, "inline_codes", r"[A-Za-z]\*[A-Za-z{]").withColumn("s", F.col("s") + 1)).select("doc_id", "s", "m")


_AUTO = document(("p", "p_partkey % 2 = 0", "A [l](/u) and <http://x.y> then http://z.org end.\n\n"), ("end", "TRUE", "Fin.\n"))


@BOOK.add("set03_links_and_autolinks", "SELECT CAST(p_partkey AS BIGINT) AS doc_id, unnest([2, 14, 32]) AS s, unnest([9, 26, 44]) AS e FROM part WHERE p_partkey % 2 = 0")
def set03(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = Facts(_AUTO.docs(spark, sf_dir), ["link_like", "autolinks"], share=True)
    return facts.table("link_like").select("doc_id", "s", "e").unionByName(facts.table("autolinks").select("doc_id", "s", "e")).distinct()


@BOOK.add("set04_set_algebra", "WITH s AS (SELECT DISTINCT p_type AS name FROM part WHERE p_partkey % 2 = 0), m AS (SELECT DISTINCT p_type AS name FROM part WHERE p_partkey % 7 = 0), x AS (SELECT DISTINCT p_type AS name FROM part WHERE p_partkey % 11 = 0) (SELECT name FROM s UNION SELECT name FROM m) EXCEPT SELECT name FROM x")
def set04(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = lambda k: table(spark, sf_dir, "part").where(f"p_partkey % {k} = 0").select(F.col("p_type").alias("name"))
    return names(2).union(names(7)).distinct().exceptAll(names(11).distinct())


@BOOK.add("set05_known_names", "SELECT n_name AS name FROM nation UNION SELECT r_name FROM region UNION SELECT n_name FROM nation")
def set05(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")), table(spark, sf_dir, "region").select(F.col("r_name").alias("name"))
    return nation.union(region).union(nation).distinct()


@BOOK.add("set06_set_equality", "SELECT (SELECT count(*) FROM (SELECT p_partkey FROM part EXCEPT SELECT p_partkey FROM part WHERE p_partkey % 13 <> 0)) AS missing, CAST(0 AS BIGINT) AS added")
def set06(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "part").select("p_partkey")
    right = left.where("p_partkey % 13 <> 0")
    missing, added = (a.exceptAll(b).agg(F.count(F.lit(1)).alias(n)) for a, b, n in ((left, right, "missing"), (right, left, "added")))
    return missing.join(added)


# Rules and fixes


_SPANS = document(("p", "p_partkey % 2 = 0", "é line\nsee $5 now\n\n"), ("end", "TRUE", "Fin.\n"))


@BOOK.add("run02_locate", f"WITH {_SPANS.placed()} {_SPANS.expected('stray-dollar', [Expect('p', '12', '1', '5', 1, extra=repr('$') + ' AS snippet')])}")
def run02(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphlake.rules.run import diagnostics, select

    docs = _SPANS.docs(spark, sf_dir)
    found = diagnostics(docs, select("none,+stray-dollar"), suppress=False).join(docs.withColumnRenamed("text", "doc"), "doc_id")
    return found.select("doc_id", "rule", "line", "col", "span_start", "span_end", T.bytes_of(F.col("doc"), F.col("span_start").cast("int"), F.col("span_end").cast("int")).alias("snippet"))


@BOOK.add("run05_final_order", f"WITH {_SPANS.placed()} SELECT CAST(p_partkey AS BIGINT) AS doc_id, unnest([1, 2]) AS k, unnest([2, CAST(l_end AS INTEGER)]) AS line FROM o WHERE p_partkey % 2 = 0 UNION ALL SELECT CAST(p_partkey AS BIGINT), 1, CAST(l_end AS INTEGER) FROM o WHERE p_partkey % 2 <> 0")
def run05(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphlake.rules.run import in_order, ordinal

    docs = _SPANS.docs(spark, sf_dir)
    points = lines_of(docs).where("text rlike '[$.]'").select("doc_id", "line", F.lit(1).alias("col"), F.lit("r").alias("rule"), F.col("e").alias("span_end"))
    return in_order(points.withColumn("k", ordinal())).select("doc_id", "k", F.col("line").cast("int").alias("line"))


@BOOK.add("fix02_splice", "SELECT CAST(p_partkey AS BIGINT) AS doc_id, 'é<' || CAST(p_partkey AS VARCHAR) || '>c!' AS text FROM part")
def fix02(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    edits = F.array(F.struct(F.lit(4).alias("s"), F.lit(0).alias("ord"), F.lit(4).alias("e"), F.lit("!").alias("r")), F.struct(F.lit(2).alias("s"), F.lit(1).alias("ord"), F.lit(3).alias("e"), F.concat(F.lit("<"), key, F.lit(">")).alias("r")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("doc_id"), T.splice(F.lit("ébc"), edits).alias("text"))


def _names(names: list[str]) -> str:
    return f"SELECT unnest([{', '.join(map(repr, names))}]) AS name, unnest(range(0, {len(names)})) AS ord"


@BOOK.add("sel02_config_selection", _names(["unbalanced-backtick", "heading-punctuation", "stray-dollar"]))
def sel02(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphlake.rules.run import select_by_config

    chosen = select_by_config("none", ["unbalanced-backtick", "heading-punctuation", "bare-url"], extend=["stray-dollar"], ignore=["bare-url"])
    return spark.createDataFrame([(n, k) for k, n in enumerate(chosen.names())], "name string, ord long")


_FENCES = document(("a", "p_partkey % 2 = 0", "```pyhton\nx\n```\n\n"), ("b", "p_partkey % 3 = 0", "```nosuch\nx\n```\n\n"), ("end", "TRUE", "Fin.\n"))


@BOOK.add("sel03_configured_rules", f"WITH {_FENCES.placed()} SELECT CAST(p_partkey AS BIGINT) AS doc_id, CAST(l_b AS BIGINT) AS line FROM o WHERE p_partkey % 3 = 0")
def sel03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules as a configuration shapes them: a language of the user's own is no typo."""
    from glyphlake.rules.run import configured, diagnostics
    from glyphlake.sources.config import load

    rules = configured(load("[lint]\nselect = ['info-string-typo']\ninfo-strings = ['pyhton']\n"))
    return diagnostics(_FENCES.docs(spark, sf_dir), rules, suppress=False).select("doc_id", "line")


@BOOK.add("sel04_registry", "SELECT unnest(['all', 'default', 'removed', 'again', 'unknown']) AS step, unnest([21, 15, 14, 15, 0]) AS n")
def sel04(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphlake.rules.run import RuleSet, select

    rules, out = RuleSet(), [("all", len(select("all"))), ("default", len(RuleSet()))]
    rule = rules.by_name("bare-url")
    rules.remove("bare-url")
    out.append(("removed", len(rules)))
    rules.add(rule)
    out += [("again", len(rules)), ("unknown", int("nosuch" in rules))]
    return spark.createDataFrame(out, "step string, n int")


@BOOK.add("sel05_did_you_mean", "WITH p AS (SELECT DISTINCT p_type AS pool FROM part WHERE p_partkey <= 20), t AS (SELECT DISTINCT p_type || 'x' AS name FROM part WHERE p_partkey <= 40), s AS (SELECT name, pool, jaro_winkler_similarity(name, pool) AS score FROM t, p) SELECT name, arg_max(pool, (round(score, 9), pool)) AS nearest FROM s WHERE score >= 0.7 GROUP BY name")
def sel05(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphlake.rules.run import suggestions

    part = table(spark, sf_dir, "part")
    pool = [r.p_type for r in part.where("p_partkey <= 20").select("p_type").distinct().collect()]  # at most 20 rows by the key
    return suggestions(part.where("p_partkey <= 40").select(F.concat("p_type", F.lit("x")).alias("name")).distinct(), pool).where("nearest is not null")
