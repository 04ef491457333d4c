"""Documents being edited, and what programs add: streams, actions, rules of their own."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from glyphlake.operators.facts import Facts
from glyphlake.operators.fixtures import Expect, _lit, markdown_docs
from glyphlake.queries.book import Book, document, table
from glyphlake.sources.config import Config, Fmt, Lint
from glyphlake.sources.scratch import shared_dir, spread
from glyphlake.streaming import editing as S

BOOK = Book()
QUERIES, ORACLE = BOOK.queries, BOOK.oracle
DOC = "CAST(p_partkey AS BIGINT) AS doc_id"
END = ("end", "TRUE", "Fin.\n")
_KIND = "CASE WHEN event_id % 23 = 0 THEN 'close' WHEN event_id % 17 = 1 THEN 'save' WHEN event_id % 13 = 2 THEN 'open' ELSE 'change' END"
_EDIT = "CAST(user_id % 97 AS VARCHAR) AS uri, CAST((event_id * 31) % 1009 AS BIGINT) AS version, {kind} AS kind, '# Edit ' || CAST(event_id AS VARCHAR) AS text, ts AS arrival".replace("{kind}", _KIND)
#: What takes effect: each open or close begins a stretch of its own; in it versions never fall.
_EFFECTS = f"""WITH e AS (SELECT {_EDIT} FROM events), g AS (SELECT *, sum(CASE WHEN kind IN ('open', 'close') THEN 1 ELSE 0 END) OVER w AS part FROM e WINDOW w AS (PARTITION BY uri ORDER BY arrival, version, kind ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
m AS (SELECT *, max(CASE WHEN kind IN ('open', 'change') THEN version END) OVER (PARTITION BY uri, part ORDER BY arrival, version, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM g),
t AS (SELECT * FROM m WHERE kind IN ('open', 'close') OR (kind = 'save' AND before IS NOT NULL) OR (kind = 'change' AND (before IS NULL OR version >= before))),
a AS (SELECT *, row_number() OVER (PARTITION BY uri ORDER BY arrival, version, kind) AS k, CASE WHEN kind = 'save' THEN before ELSE version END AS now,
  count(*) FILTER (WHERE kind = 'close') OVER (PARTITION BY uri ORDER BY arrival, version, kind ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS closes_after FROM t)"""


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of files."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque*")


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream(spark, sf_dir, "events").selectExpr(*_EDIT.replace("AS VARCHAR", "AS STRING").split(", ", 2)[:2], f"{_KIND} AS kind", "'# Edit ' || CAST(event_id AS STRING) AS text", "ts AS arrival")


def effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.run_to_end(S.accepted(edits(spark, sf_dir)), shared_dir(spark))


@BOOK.add("stm01_open_documents", f"{_EFFECTS}, x AS (SELECT uri, arg_max(now, k) AS version, arg_max(kind, k) AS kind FROM a GROUP BY uri) SELECT uri, version FROM x WHERE kind <> 'close'")
def stm01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.open_documents(effects(spark, sf_dir)).select("uri", "version")


@BOOK.add("stm02_whole_text_replacement", "SELECT CAST(p_partkey % 10 AS VARCHAR) AS uri, arg_max('first ' || CAST(p_partkey AS VARCHAR), p_partkey) AS text FROM part GROUP BY uri")
def stm02(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    rows = stream(spark, sf_dir, "part").select((F.col("p_partkey") % 10).cast("string").alias("uri"), F.col("p_partkey").cast("long").alias("version"), F.lit("change").alias("kind"), F.array(F.concat(F.lit("first "), key), F.lit("second")).alias("changes"), F.timestamp_seconds("p_partkey").alias("arrival"))
    rows = S.run_to_end(S.accepted(rows.withColumn("text", S.first_change(F.col("changes"))).drop("changes")), shared_dir(spark))
    return S.open_documents(rows).select("uri", "text")


@BOOK.add("stm05_stale_results", f"{_EFFECTS}, x AS (SELECT uri, arg_max(now, k) AS version, arg_max(kind, k) AS kind FROM a GROUP BY uri) SELECT DISTINCT a.uri, a.now AS version FROM a JOIN x ON a.uri = x.uri AND a.now = x.version WHERE x.kind <> 'close' AND a.kind <> 'close' AND a.k % 2 = 0")
def stm05(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = effects(spark, sf_dir)
    results = rows.where("kind <> 'close'").select("uri", "version", (F.col("n") % 2).cast("int").alias("revision"))
    return S.current_results(results, S.open_documents(rows), 0).select("uri", "version").distinct()


@BOOK.add("stm06_close_forgets", f"{_EFFECTS} SELECT uri, k AS n, now AS version, CASE WHEN kind = 'close' THEN 'closed' ELSE 'open' END AS status FROM a")
def stm06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return effects(spark, sf_dir).select("uri", "n", "version", "status")


_REVISIONS = [Config(Lint(select=["heading-punctuation"])), Config(Lint(select=["heading-punctuation"], ignore=["heading-punctuation"])), Config(Lint(preset="none", extend_select=["stray-dollar"]))]
_LINTED = document(("h", "p_partkey % 2 = 0", "# Head.\n\n"), ("d", "p_partkey % 3 = 0", "It is $5.\n\n"), END)


@BOOK.add("stm07_new_configuration", "SELECT 1 AS revision, 'heading-punctuation' AS rule, count(*) AS n FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 3, 'stray-dollar', count(*) FROM part WHERE p_partkey % 3 = 0")
def stm07(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _LINTED.docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("uri"), F.lit(1).alias("version"), "text")
    found = None
    for k, c in enumerate(_REVISIONS, 1):
        rows = S.relint(docs, c, k)
        found = rows if found is None else found.unionByName(rows)
    return found.groupBy("revision", "rule").agg(F.count(F.lit(1)).alias("n"))


@BOOK.add("stm08_due_at_once", f"{_EFFECTS} SELECT uri, k AS n, kind FROM a WHERE kind IN ('open', 'save')")
def stm08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return effects(spark, sf_dir).where("due = 'now' and kind <> 'close'").select("uri", "n", "kind")


@BOOK.add("stm09_size_guard", "SELECT CAST(doc_id AS VARCHAR) AS uri, CASE WHEN strlen(text) > 1000 THEN 'too-large' ELSE 'open' END AS status FROM documents WHERE text IS NOT NULL")
def stm09(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = stream(spark, sf_dir, "documents").where("text is not null")
    opened = docs.select(F.col("doc_id").cast("string").alias("uri"), F.lit(1).cast("long").alias("version"), F.lit("open").alias("kind"), "text", F.timestamp_seconds(F.lit(0)).alias("arrival"))
    return S.run_to_end(S.accepted(opened, limit=1000), shared_dir(spark)).select("uri", "status")


_ROWS = document(("a", "TRUE", "* one\n\n"), ("b", "p_partkey % 2 = 0", "Some _soft_ words.\n\n"), ("c", "TRUE", "An _other_ line.\n\n"))


@BOOK.add("stm10_range_edits", f"SELECT {DOC}, 7 AS s, 27 AS e, {_lit('Some *soft* words.' + chr(10) * 2)} AS text FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT {DOC}, 7, 25, {_lit('An *other* line.' + chr(10) * 2)} FROM part WHERE p_partkey % 2 <> 0")
def stm10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.range_edits(_ROWS.docs(spark, sf_dir), F.lit(9), F.lit(12), Fmt(italic="asterisk"))


_ACTED = document(("h", "p_partkey % 2 = 0", "# Head.\n\n"), ("u", "TRUE", "See http://x.org now\n\n"))


@BOOK.add("stm11_code_actions", f"WITH {_ACTED.placed()} SELECT {DOC}, 'bare-url' AS rule, '<http://x.org>' AS replacement, CASE WHEN p_partkey % 2 = 0 THEN {_lit('# Head' + chr(10) * 2)} ELSE '' END || {_lit('See <http://x.org> now' + chr(10) * 2)} AS fixed FROM o WHERE o_u + 4 <= 12 AND o_u + 16 >= 10")
def stm11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The safe fixes at a range of bytes, and the text with all of them applied."""
    from glyphlake.rules.run import diagnostics, fixed, select

    docs = _ACTED.docs(spark, sf_dir)
    found = diagnostics(docs, select("none,+bare-url,+heading-punctuation"))
    here = S.actions(found, 10, 12).where("rule = 'bare-url'").select("doc_id", "rule", "replacement")
    return here.join(fixed(docs, found).select("doc_id", F.col("text").alias("fixed")), "doc_id")


@BOOK.add("stm12_hover", f"WITH {_ACTED.placed()} SELECT {DOC}, 'bare-url' AS rule FROM o WHERE l_u = 3")
def stm12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphlake.rules.run import diagnostics, select

    return S.covering(diagnostics(_ACTED.docs(spark, sf_dir), select("none,+bare-url,+heading-punctuation")), 3, 8).select("doc_id", "rule")


@BOOK.add("stm13_position_encoding", f"SELECT {DOC}, CASE WHEN p_partkey % 3 = 0 THEN 'utf-8' ELSE 'utf-16' END AS encoding, p_partkey % 3 = 0 AS edits FROM part")
def stm13(spark: SparkSession, sf_dir: str) -> DataFrame:
    offers = F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit("utf-32"), F.lit("utf-8"))).when(F.col("p_partkey") % 3 == 1, F.array(F.lit("utf-16")))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("doc_id"), S.negotiated(offers).alias("encoding"))
    return rows.withColumn("edits", F.col("encoding") == "utf-8")


@BOOK.add("snk11_published_findings", f"{_EFFECTS} SELECT uri, 'heading-punctuation' AS rule, CAST(1 AS BIGINT) AS line FROM a WHERE kind <> 'close' GROUP BY uri")
def snk11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of each micro-batch as they are published."""
    from glyphlake.rules.run import select

    path = f"{shared_dir(spark)}/published-{uuid.uuid4().hex}"
    ended = edits(spark, sf_dir).withColumn("text", F.concat("text", F.lit(".\n")))
    query = S.lint_each(ended, lambda found: found.select("uri", "rule", "line").write.mode("append").parquet(path), select("none,+heading-punctuation"), f"{path}-marks")
    query.awaitTermination()
    return spark.read.schema("uri string, rule string, line long").parquet(path)


_TODO = document(("t", "p_partkey % 2 = 0", "A TODO here.\n\n"), ("f", "p_partkey % 3 = 0", "Now FIXME, TODO.\n\n"), ("off", "p_partkey % 5 = 0", "<!-- lint: allow-next-line no-todo -->\nOne TODO off.\n\n"), END)
_TODO_SPOTS = [Expect("t", "2", "4", "3"), Expect("f", "11", "4", "12")]


def _marker_rule(name: str, words: str, default: bool = True, codes: bool = False):
    from glyphlake.rules.stdlib import Rule, found, in_text

    def check(facts: Facts) -> DataFrame:
        hits = in_text(facts, "prose", rf"\b(?:{words})\b")
        rows = found(hits, "s", "e", F.concat(F.lit("marker "), "m"))
        return rows.withColumn("rule", F.when(F.col("message") == "marker FIXME", f"{name}/fixme").otherwise("")) if codes else rows

    return Rule(name, ("prose",), check, "A marker that was left in the text", default=default)


_COLUMNS = ["doc_id", "rule", "line", "col", "span_start", "span_end"]


@BOOK.add("udf01_rule_of_ones_own", f"WITH {_TODO.placed()} {_TODO.expected('no-todo', [*_TODO_SPOTS, Expect('off', '43', '4', '5', 1)])}")
def udf01(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphlake.rules.run import RuleSet, diagnostics

    return diagnostics(_TODO.docs(spark, sf_dir), RuleSet([_marker_rule("no-todo", "TODO")]), suppress=False).select(_COLUMNS)


@BOOK.add("udf02_engine_with_extra_rules", f"WITH {_TODO.placed()} {_TODO.expected('no-todo', _TODO_SPOTS)}")
def udf02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registered rule runs beside the standard ones, and directives know its name."""
    from glyphlake.api import Engine

    engine = Engine()
    engine.register(_marker_rule("no-todo", "TODO"))
    return engine.check(_TODO.docs(spark, sf_dir)).select(_COLUMNS)


@BOOK.add("udf02_sql_table_function", f"SELECT {DOC}, CAST(length(CAST(p_partkey AS VARCHAR)) + 2 AS INTEGER) AS e, CAST(p_partkey AS VARCHAR) AS text FROM part")
def udf02_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphlake.api import register_functions

    register_functions(spark)
    spread(table(spark, sf_dir, "part")).select(F.col("p_partkey").cast("long").alias("doc_id"), F.concat(F.lit("# "), F.col("p_partkey").cast("string"), F.lit("\n\nText\n")).alias("text")).createOrReplaceTempView("udf02_documents")
    return spark.sql("SELECT d.doc_id, f.e, f.text FROM udf02_documents d, LATERAL md_facts(d.text, 'headings') f")


@BOOK.add("udf03_rules_of_several_codes", f"WITH {_TODO.placed()} {_TODO.expected('marker', [*_TODO_SPOTS, Expect('off', '43', '4', '5', 1)])} UNION ALL {_TODO.expected('marker/fixme', [Expect('f', '4', '5', '5')])}")
def udf03(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphlake.rules.run import RuleSet, diagnostics

    return diagnostics(_TODO.docs(spark, sf_dir), RuleSet([_marker_rule("marker", "TODO|FIXME", codes=True)]), suppress=False).select(_COLUMNS)


_ALL = document(("h", "p_partkey % 2 = 0", "# Head.\n\n"), ("m", "TRUE", "Let \\(\\alpha\\) be.\n"))


@BOOK.add(
    "udf04_library",
    f"SELECT {DOC}, CAST(p_partkey % 2 = 0 AS INTEGER) AS findings, CASE WHEN p_partkey % 2 = 0 THEN {_lit('# Head' + chr(10) * 2)} ELSE '' END || {_lit('Let ' + chr(92) + '(' + chr(92) + 'alpha' + chr(92) + ') be.' + chr(10))} AS fixed, "
    f"CASE WHEN p_partkey % 2 = 0 THEN {_lit('<h1>Head.</h1>' + chr(10))} ELSE '' END || {_lit('<p>Let (' + chr(92) + 'alpha) be.</p>' + chr(10))} AS html, CASE WHEN p_partkey % 2 = 0 THEN {_lit('# Head.' + chr(10) * 2)} ELSE '' END || {_lit('Let ' + chr(92) + '(α' + chr(92) + ') be.' + chr(10))} AS translated FROM part",
)
def udf04(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphlake.api import Engine

    engine, docs = Engine(), _ALL.docs(spark, sf_dir)
    found = engine.check(docs, locate=False).groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("findings"))
    out = engine.fix(docs).select("doc_id", F.col("text").alias("fixed")).join(engine.render(docs), "doc_id")
    out = out.join(engine.translate(docs, "unicode").select("doc_id", F.col("text").alias("translated")), "doc_id").join(found, "doc_id", "left")
    return out.withColumn("findings", F.coalesce("findings", F.lit(0)))
