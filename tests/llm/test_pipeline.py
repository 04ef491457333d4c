import random

import pytest

import corpus_pipeline as p
from glyphlake.llm import queries
from glyphlake.llm.packing import token_ids
from glyphlake.llm.simhash import fingerprint

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(12)
    voc = {"en": ["thon", "ther", "ing", "ed", "wh"], "fr": ["eau", "oux", "é", "tion", "qu"]}
    text = lambda lang, n: " ".join("".join(rnd.choice(voc[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(n))
    items = [(k, text("en", 30)) for k in range(5)]
    rows = [(k, text(lang := rnd.choice(["en", "fr"]), rnd.randint(40, 200)), lang, "s", 1) for k in range(200)]
    rows += [(300 + k, rows[0][1], "en", "s", 1) for k in range(30)]
    rows += [(400, text("en", 50) + " " + items[2][1] + " " + text("en", 50), "en", "s", 1), (401, "12345 67 !!", "en", "s", 1), (402, None, "en", "s", 1)]
    rows += [(403, text("en", 40) + ' token = "0123456789abcdef0123456789abcdef" ' + text("en", 3), "en", "s", 1), (404, rows[1][1], None, None, None), (405, text("en", 9000), "en", "s", 1)]
    rows += [rows[5]]
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(d + "/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(d + "/benchmark.parquet")
    return d, rows, items


def test_stages_one_by_one(spark, corpus, tmp_path):
    d, rows, _ = corpus
    docs = spark.read.parquet(d + "/documents.parquet")
    texts = {i: t for i, t, *_ in rows}
    seen = {}
    for k, (name, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, d)
        if k < len(p.STAGES) - 1:
            assert out.columns == p.COLUMNS
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = docs.collect()
    ids = {name: sorted(r.doc_id for r in got) for name, got in seen.items()}
    assert set(texts) - set(ids["language_id"]) == {401, 402}
    first: dict = {}
    for i in sorted(set(ids["language_id"])):
        first.setdefault(fingerprint(texts[i]), i)
    assert ids["near_copies"] == sorted(first.values())  # no two of these prints lie within two bits, see below
    prints = sorted(first)
    assert all((a ^ b).bit_count() > 2 for k, a in enumerate(prints) for b in prints[:k])
    assert set(ids["near_copies"]) - set(ids["benchmark_leaks"]) == {400}
    assert ids["secrets"] == ids["benchmark_leaks"]
    clean = {r.doc_id: r.text for r in seen["secrets"]}
    assert "0123456789abcdef" not in clean[403] and all(clean[i] == texts[i] for i in clean if i != 403)
    assert {r.doc_id: r.n_chars for r in seen["secrets"]}[403] == len(clean[403])
    tokens: dict = {}
    for r in seen["packing"]:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
    assert tokens == {i: len(token_ids(t, "byte_bpe_50k")) + 1 for i, t in clean.items()}


def test_run_equals_the_stages(spark, corpus):
    d, *_ = corpus
    docs = spark.read.parquet(d + "/documents.parquet")
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, d)
    want = {(r.doc_id, r.length) for r in p.pack(spark, docs, d).collect()}
    assert {(r.doc_id, r.length) for r in p.run(spark, d).collect()} == want


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_every_query_runs(spark, name):
    out = queries.QUERIES[name](spark, SF)
    table = {"op3": "pages", "op7": "embeddings"}.get(name.split("_")[0], "documents")
    rows = out.count()
    assert rows >= spark.read.parquet(f"{SF}/{table}.parquet").count() if name.startswith("op4") else rows == spark.read.parquet(f"{SF}/{table}.parquet").count()
