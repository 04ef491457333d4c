import random
import re

from glyphlake.llm.decontam import char_spans, contamination, covered

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, width):
    windows = []
    for i, t in items:
        w = words(t)
        windows += [(i, w[k : k + width]) for k in range(len(w) - width + 1)] if len(w) >= width else [(i, w)] * bool(w)
    out = []
    for d, t in docs:
        ws, hit, ids = words(t), set(), set()
        for i, win in windows:
            for k in range(len(ws) - len(win) + 1):
                if ws[k : k + len(win)] == win:
                    hit |= set(range(k, k + len(win)))
                    ids.add(i)
        out.append((d, len(ws), len(hit), len(ids), sorted(map(str, ids)), len(ids) >= 2))
    return sorted(out, key=str)


def test_against_brute_force(spark, make_docs):
    rnd = random.Random(1)
    voc = ["a", "b", "C", "é", "d4", "Ü", "漢字", "x"]
    text = lambda n: "".join(rnd.choice(voc) + rnd.choice([" ", "-", "\n", "... ", "_"]) for _ in range(n))
    items = [(k, text(rnd.randint(1, 12))) for k in range(12)] + [(20, None), (21, "..."), (22, "é"), (10, "a b C")]
    docs = [(k, text(rnd.randint(0, 60))) for k in range(30)] + [(50, items[0][1] + " zz " + items[1][1]), (51, None), (52, ""), (50, "a"), (None, items[2][1])]
    docs += [(53, "filler " * 5000 + items[3][1])]
    table = spark.createDataFrame(items, "item_id long, text string")
    for block_chars in (10_000, 20):  # one automaton, several
        out = contamination(make_docs(docs, clash=True), table, width=4, block_chars=block_chars).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r["items"], r.contaminated) for r in out), key=str) == brute(docs, items, 4)


def test_offsets_lead_back_to_the_text(spark, make_docs):
    out = contamination(make_docs([(1, "Say: The QUICK-brown  fox, ok")]), spark.createDataFrame([(1, "the quick brown fox")], "item_id long, text string"), width=4).first()
    assert [("Say: The QUICK-brown  fox, ok")[a:b] for a, b in zip(out.char_spans[::2], out.char_spans[1::2], strict=True)] == ["The QUICK-brown  fox"]
    assert covered([3, 1, 9], [5, 4, 10]) == [(1, 5), (9, 10)]
    assert char_spans("a b c", [(0, 1), (2, 3)]) == [(0, 1), (4, 5)]


def test_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination(make_docs([]), none).collect() == []
    out = contamination(make_docs([(1, "a b")]), none).first()
    assert (out.n_words, out.n_hit, out.n_items, out.contaminated) == (2, 0, 0, False)
