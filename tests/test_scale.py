"""Steps whose work or memory has to grow no faster than their input."""

import random
import time

from pyspark.sql import functions as F

from glyphlake.functions import text as T
from glyphlake.operators import compare as C, ranges as R


def test_matches_of_a_long_text_take_no_square_of_their_number(spark):
    n = 20000
    rows = spark.range(1).select(F.repeat(F.lit("é nation "), n).alias("text")).select(F.explode(T.matches(F.col("text"), "[a-z]+tion")).alias("x"))
    start = time.monotonic()
    got = rows.agg(F.count("x").alias("n"), F.min("x.s").alias("first"), F.max("x.e").alias("last"), F.count_if((F.col("x.s") - 3) % 10 == 0).alias("placed")).first()
    assert tuple(got) == (n, 3, 10 * n - 1, n)
    assert time.monotonic() - start < 60


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_classes_send_only_their_table_to_the_driver(spark):
    differences = spark.createDataFrame([("c0", "d1/e2/f", 1), ("c0", "d1/x", 2), ("c9", "y", 3), ("c9", "y", 4), (None, "d1/x", 5), ("c0", None, 6)], "corpus string, path string, k int")
    rows = spark.createDataFrame([(0, "c0", "d1/e2/**", "fixed"), (1, "*", "d1/**", "open-bug"), (2, "c0", "*", "configured"), (3, None, "y", "fixed")], "ord int, corpus string, pattern string, status string")
    first, rest = C.classify(differences, rows)
    assert sorted(map(tuple, first.select("path", "ord", "status").collect())) == [("d1/e2/f", 0, "fixed"), ("d1/x", 1, "open-bug"), ("d1/x", 1, "open-bug")]
    assert sorted(r.k for r in rest.collect()) == [3, 4, 6]
    for df in (first, rest):
        assert "Generate" not in plan(df) and "HashJoin" not in plan(df) and "MergeJoin" not in plan(df)


def test_the_next_close_reads_its_window_once(spark):
    rows = spark.createDataFrame([(1, 1, False), (1, 2, False), (1, 3, True), (1, 5, True), (1, 6, False), (2, 1, True)], "doc_id long, s long, enable boolean")
    out = R.next_close(rows, F.col("enable"))
    assert sorted((r.doc_id, r.s, r.close) for r in out.collect()) == [(1, 1, 3), (1, 2, 3), (1, 3, 5), (1, 5, None), (1, 6, None), (2, 1, None)]
    assert "unboundedfollowing" not in plan(out).lower()


def test_snapping_reads_its_windows_once(spark):
    rows = spark.createDataFrame([(1, 3, 4, "a"), (1, 5, 5, "b"), (1, 9, 12, "c"), (2, 0, 1, "d")], "doc_id long, s int, e int, id string")
    marks = spark.createDataFrame([(1, 3), (1, 5), (1, 10)], "doc_id long, s int")
    out = R.snapped(rows, marks)
    assert sorted((r.id, r.lo, r.hi) for r in out.collect()) == [("a", 3, 5), ("b", 5, 5), ("c", 5, None), ("d", None, None)]
    assert "unboundedfollowing" not in plan(out).lower()


def test_the_deepest_cover_makes_no_pairs_of_points_and_items(spark):
    rnd = random.Random(7)
    items = [(k % 3, s, s + rnd.choice([0, 1, 2, 7, 64, 1000]), k) for k in range(400) for s in [rnd.randint(0, 900)]] + [(1, 2**31 - 9, 2**31 - 1, 400)]
    points = [(k % 4, rnd.randint(0, 1100), k) for k in range(300)] + [(1, 2**31 - 2, 300), (1, 2**31 - 1, 301)]
    got = R.deepest(spark.createDataFrame(points, "doc_id long, s int, id long"), spark.createDataFrame(items, "doc_id long, s int, e int, owner long"), "owner").collect()
    best = {id_: max(((s, o) for d, s, e, o in items if d == doc and s <= at < e), default=None) for doc, at, id_ in points}
    assert {r.id: r.owner for r in got} == {k: v[1] for k, v in best.items() if v}
    n = 30000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("s"), "id")
    start = time.monotonic()
    out = R.deepest(rows, rows.select("doc_id", "s", F.lit(2 * n).alias("e"), F.col("id").alias("owner")), "owner")
    assert out.where("id = owner").count() == n
    assert time.monotonic() - start < 60


def test_neighbours_of_equal_ranges_follow_their_ties(spark):
    rows = spark.createDataFrame([(1, 0, 5, k) for k in range(50)] + [(1, 9, 12, 50)], "doc_id long, s int, e int, id long")
    for n in (1, 3, 7):
        out = R.neighbours(rows.orderBy(F.desc("id")).repartition(n), ("id",)).where("gap = 4").collect()
        assert [r.id for r in out] == [49]


def test_rows_as_long_as_the_corpus_are_not_broadcast(spark):
    """The planner takes a computed text for a few bytes, so small keys with long texts look small enough to broadcast."""
    from glyphlake.operators.facts import located

    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("- é\n"), 3).alias("text"))
    found = located(docs.select("doc_id", F.lit(6).alias("s")), docs)
    html = docs.select("doc_id", F.lit('<p data-sourcepos="1:1-2:3">').alias("html"))
    for df, n in ((found, 1000), (C.envelopes(html, docs), 1000)):
        assert "Broadcast" not in plan(df)
        assert df.count() == n


def test_one_rule_parses_each_document_once(spark, monkeypatch):
    from glyphlake.operators import facts as module
    from glyphlake.rules.run import diagnostics, select

    parsed = []
    monkeypatch.setattr(module, "written", lambda df, label: parsed.append(label) or df)
    docs = spark.createDataFrame([(1, "A \\alpha here.\n")], "doc_id long, text string")
    diagnostics(docs, select("none,+latex-command"))
    assert parsed == ["facts"]


def test_small_tables_are_dealt_out_before_python(spark):
    from glyphlake.queries import formatting, sessions, structure

    for query in (structure.QUERIES["mth08_environment_class"], sessions.QUERIES["udf02_sql_table_function"], formatting.QUERIES["fmt25_first_divergence"]):
        assert query(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_byte_offsets_of_wide_characters():
    from glyphlake.parse.facts import parse

    text = "é漢😀 *a* é\n\n# 漢 x\n\n- 😀 `é`\n"
    for kind, rows in parse(text).facts.items():
        for f in rows:
            assert 0 <= f["s"] <= f["e"] <= len(text.encode()) and text.encode()[f["s"] : f["e"]].decode() is not None, kind
    assert [(f["s"], f["e"]) for f in parse(text).facts["inline_codes"]] == [(34, 38)]


def test_candidates_are_refused_by_their_blocks_before_their_words(monkeypatch):
    """Salvage parses each candidate once, reads words only where the blocks are those of the source, and keeps what passed."""
    from glyphlake.fmt import engine as E
    from glyphlake.parse import facts as P
    from glyphlake.sources.config import Fmt

    read, words = [], []
    monkeypatch.setattr(E, "read", lambda text, old=E.read: read.append(text) or old(text))
    monkeypatch.setattr(P, "Inline", lambda *a, old=P.Inline: words.append(1) or old(*a))
    text, report = E.format_text("- one\n- two\n* three\n\nFin.\n", Fmt(list_marker="plus"))
    assert text == "- one\n- two\n+ three\n\nFin.\n" and (report.proposed, report.applied) == (5, 1)
    assert len(read) == len(set(read)) == 7 and len(words) == 8


def test_parsed_documents_go_without_the_collector():
    """A parse must not hang in a cycle, or a batch of documents stays in memory until the collector runs."""
    import gc
    import weakref

    from glyphlake.fmt import engine as E
    from glyphlake.parse.facts import parse
    from glyphlake.sources.config import Fmt

    gc.collect()
    gc.disable()
    try:
        gone = weakref.ref(parse("- a\n  > b *c*\n\n| x |\n|---|\n"))
        assert gone() is None
        E.format_text("- one\n- two\n* three\n\nFin.\n", Fmt(list_marker="plus", wrap=20))
        assert not [x for x in gc.get_objects() if type(x).__name__ == "Parsed"]
    finally:
        gc.enable()


def test_one_edit_of_a_document_is_accepted_without_sorting(spark, monkeypatch):
    import pandas as pd

    from glyphlake.queries.sessions import stream
    from glyphlake.streaming import editing as S

    class State:
        exists, get = False, None

        def update(self, value):
            self.get = value

        def remove(self):
            self.get = None

    def edits(*rows):
        return pd.DataFrame([(v, k, t, pd.Timestamp(at, unit="s")) for v, k, t, at in rows], columns=["version", "kind", "text", "arrival"])

    two, state = iter([edits((3, "change", "c", 2)), edits((1, "open", "a", 1), (2, "change", "too long", 3))]), State()
    assert [r[1:5] for r in next(S.accept(("u",), two, state, 5)).itertuples(index=False, name=None)] == [(1, 1, "open", "a"), (2, 3, "change", "c")]
    assert state.get == (3, "c", 2)
    monkeypatch.setattr(pd, "concat", None)
    monkeypatch.setattr(pd.DataFrame, "sort_values", None)
    out = next(S.accept(("u",), iter([edits((1, "open", "long text", 1))]), State(), 5))
    assert list(out.itertuples(index=False, name=None)) == [("u", 1, 1, "open", None, "too-large", "now")]
    out = next(S.accept(("u",), iter([edits((1, "save", None, 1))]), State(), 5))
    assert len(out) == 0 and list(out.columns) == ["uri", "n", "version", "kind", "text", "status", "due"]
    rows = stream(spark, "/root/testdata/sf0.001", "documents").selectExpr("cast(doc_id as string) as uri", "1L as version", "'open' as kind", "text", "timestamp_seconds(0) as arrival")
    assert "octet_length" in S.accepted(rows, 5)._jdf.queryExecution().logical().toString()  # large texts stay out of the shuffle


def test_texts_reach_python_in_slices_bounded_by_bytes():
    import pyarrow as pa

    from glyphlake.operators.batches import slices

    texts = ["a" * 10, None, "é" * 30, "b", "", "c" * 5, "d" * 95, "e" * 5] + ["f"] * 7
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["k", "t"])
    out = list(slices(iter([batch, batch.slice(0, 0)]), rows=4, size=100))
    assert [x for b in out for x in b.column(1).to_pylist()] == texts
    assert [b.num_rows for b in out] == [4, 3, 4, 4]


def test_formatting_holds_a_slice_and_not_the_batch(spark):
    import pyarrow as pa

    from glyphlake.fmt.engine import formatted
    from glyphlake.sources.config import Fmt

    class Docs:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(["word é " * 30] * 3000)], names=["doc_id", "text"])
    out = list(formatted(Docs(), Fmt(wrap=80))(iter([batch])))
    assert sum(b.num_rows for b in out) == 3000 and max(b.num_rows for b in out) <= 500


def test_only_changed_texts_are_linted_again(spark, monkeypatch):
    from glyphlake.rules import run as R

    given = []
    monkeypatch.setattr(R, "diagnostics", lambda docs, *a, old=R.diagnostics, **k: given.append(sorted(r.doc_id for r in docs.collect())) or old(docs, *a, **k))
    texts = ["# A.\n\nOne ` tick.\n", "# B\n\nOne ` tick. \\( x\n", "Nothing.\n", None, "See http://a.org/x now. x`y`\n\n# C\n\n# c\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = sorted(map(tuple, R.left_after_fixes(docs).select("doc_id", "rule", "span_start", "span_end").collect()))
    assert given == [[0, 1, 2, 3, 4], [0, 4]]
    whole = R.diagnostics(R.fixed(docs, R.diagnostics(docs, locate=False)), locate=False)
    assert found == sorted(map(tuple, whole.select("doc_id", "rule", "span_start", "span_end").collect())) and len(found) == 4


def test_lines_without_inline_syntax_or_marks_cost_no_inline_structure(monkeypatch):
    from glyphlake.parse import facts as P
    from glyphlake.rules.stdlib import RULES

    wanted = {n for r in RULES.values() if r.default for n in r.needs}
    marks = "".join(r.marks for r in RULES.values() if r.default and "prose" in r.needs)
    text = "# Plain\n\nTwo plain\nlines.\n\n| a | b{1} |\n|---|---|\n| c | WWW.x.org |\n\nA x^{2}: here\nand there.\n\nIn `co\nde`, me@x.org\n"
    whole, made = P.parse(text).facts, []
    monkeypatch.setattr(P, "Inline", lambda lines, refs, old=P.Inline: made.append(lines[0][0]) or old(lines, refs))
    some = P.parse(text, wanted=wanted, marks=marks).facts
    assert made == ["b{1}", "WWW.x.org", "A x^{2}: here", "In `co"]
    assert [f["text"] for f in some["prose"]] == ["b{1}", "A x^{2}: here"]
    assert some["prose"] == [f for f in whole["prose"] if any(c in f["text"] for c in marks)]
    assert all(some.get(k) == whole.get(k) for k in wanted - {"prose", "blank_ends"})


def test_blank_ends_are_found_by_the_parse_in_linear_time(spark, monkeypatch):
    from glyphlake.operators import facts as O
    from glyphlake.parse.facts import blank_ends, byte_offsets

    text = "é  \n  \n \t\n\na b\t \n漢 x "
    assert [(f["s"], f["e"], f["text"], f["n"]) for f in blank_ends(text, byte_offsets(text))] == [(2, 4, "  ", 3), (5, 7, "  ", 2), (8, 10, " \t", 2), (15, 17, "\t ", 5), (23, 24, " ", 4)]
    start = time.monotonic()
    assert blank_ends((" " * 300000 + "x\n") * 2, lambda i: i) == []
    assert time.monotonic() - start < 10

    def fail(*a, **k):
        raise ValueError

    monkeypatch.setattr(O, "parse", fail)
    docs = spark.createDataFrame([(1, "a \r\nb\t")], "doc_id long, text string")
    rows = O.parse_facts(docs, ["blank_ends", "parse_errors"]).collect()
    assert sorted((r.fact, r.s, r.e) for r in rows) == [("blank_ends", 1, 2), ("blank_ends", 4, 5), ("parse_errors", 0, 0)]


def test_every_rule_finds_only_prose_with_its_marks(spark):
    from dataclasses import replace

    from glyphlake.operators.fixtures import markdown_docs
    from glyphlake.rules.run import RuleSet, diagnostics
    from glyphlake.rules.stdlib import RULES

    docs = markdown_docs(spark, "/root/testdata/sf0.001").cache()
    for names in ([n for n, r in RULES.items() if r.marks], ["subscript-damage"]):
        few, all_ = ([replace(RULES[n], **more) for n in names] for more in ({}, {"marks": None}))
        a, b = (sorted(map(tuple, diagnostics(docs, RuleSet(x), locate=False).select("doc_id", "rule", "span_start", "span_end").collect())) for x in (few, all_))
        assert a == b and a


def test_splits_of_one_file_are_dealt_out_evenly(spark):
    from glyphlake.sources.scratch import spread

    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(1000).coalesce(1).union(spark.range(0)).repartition(cores + 1, F.lit(1))
    assert spread(rows).rdd.getNumPartitions() == cores + 1
    assert max(spread(rows, 4).rdd.glom().map(len).collect()) <= 1000 / cores + 8
