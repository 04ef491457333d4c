import random

import numpy as np
from pyspark.sql import functions as F

from glyphlake.llm import langid

VOC = {"aa": ["thon", "ther", "ing", "ed", "wh", "sh"], "bb": ["eau", "oux", "é", "tion", "qu"], "cc": ["sch", "ung", "ü", "ein", "ich"]}


def text(rnd, lang, n):
    return " ".join("".join(rnd.choice(VOC[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(n))


def test_held_out_accuracy_and_odd_rows(make_docs):
    rnd = random.Random(6)
    rows = [(k, text(rnd, lang, rnd.randint(3, 200)), lang) for k, lang in enumerate(rnd.choice(list(VOC)) for _ in range(600))]
    odd = [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 !!", "bb"), (1003, text(rnd, "bb", 20000), None), (1004, "½ ² Ⅷ", "bb"), (None, text(rnd, "cc", 30), "cc")]
    docs = make_docs(rows + odd, "doc_id long, text string, lang string")
    out_col = langid.is_held_out(F.col("doc_id"))
    predictor = langid.train(docs.where(~out_col), per_language=100)
    out = langid.identify(docs.withColumn("held", out_col), predictor, ["doc_id", "lang", "held"]).collect()
    assert len(out) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held and r.doc_id < 1000]
    assert len(held) > 100 and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    by = {r.doc_id: r for r in out}
    assert [by[k].lang_pred for k in (1000, 1001, 1002, 1004)] == ["und"] * 4
    assert by[1003].lang_pred == "bb" and by[None].lang_pred == "cc" and by[None].held is False


def test_whole_text_is_read():
    for n in (1, 250, 251, 252, 256, 257, 503, 1000):
        rows, sizes = langid.windows("x" * n)
        assert len(rows) * langid._STRIDE >= n - max(langid.WIDTHS) + 1 and int(sum(sizes)) == max(n, 1)
        assert (rows != 0).any(axis=0).sum() == min(n, langid.WINDOW)


def test_tables_equal_the_convolution():
    model = langid.ByteCNN(["a", "b"])
    x = np.random.default_rng(1).integers(1, 256, (5, langid.WINDOW)).astype(np.uint8)
    emb, pooled = model.p["E"][x], []
    for w in langid.WIDTHS:
        z = sum(emb[:, k : k + langid.WINDOW - w + 1] @ model.p[f"K{w}"][k] for k in range(w)) + model.p[f"B{w}"]
        pooled.append(z.max(axis=1))
    logits = np.maximum(np.concatenate(pooled, axis=1), 0) @ model.p["W"] + model.p["c"]
    want = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
    assert np.allclose(langid.Predictor(model).log_probs(x), want, atol=1e-4)


def test_nothing_to_learn_from(make_docs):
    docs = make_docs([(1, "abc", None)], "doc_id long, text string, lang string")
    out = langid.identify(docs, langid.train(docs), ["doc_id"]).first()
    assert (out.lang_pred, out.score) == ("und", 0.0)
    empty = make_docs([], "doc_id long, text string, lang string")
    assert langid.identify(empty, langid.train(empty), ["doc_id"]).collect() == []


def test_copies_do_not_crowd_the_sample(make_docs):
    rnd = random.Random(9)
    rows = [(k, "one hot text", "aa") for k in range(3000)] + [(5000 + k, text(rnd, "bb", 20), f"l{k % 30}") for k in range(300)] + [(9000, None, "aa"), (9001, "x", None)]
    sample = langid.training_sample(make_docs(rows, "doc_id long, text string, lang string"), 5, "text", "lang")
    assert sample.count(("aa", "one hot text")) == 1 and len(sample) == len(set(sample))
    counts = {lang: sum(x == lang for x, _ in sample) for lang, _ in sample}
    assert len(counts) == 31 and all(n == 5 for lang, n in counts.items() if lang != "aa")


def test_floor_does_not_hang_on_the_number_of_labels():
    for labels in (["a"], ["a", "b"], ["a", "b", "c", "d"]):
        predictor = langid.Predictor(langid.ByteCNN(labels))
        predictor.usual = 0.9
        assert 1 / len(labels) <= predictor.floor(0.15) <= max(0.9, 1 / len(labels))
