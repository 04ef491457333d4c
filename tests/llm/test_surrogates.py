import re

from pyspark.sql import functions as F

from glyphlake.llm import surrogates
from glyphlake.llm.common import Workspace


def luhn(s):
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(s)))) % 10


def run(docs, key="k"):
    return surrogates.replace_personal_data(docs, key)


def test_kinds_formats_and_coreference(make_docs):
    rows = [
        (1, "Mail Anna.b7@x.example.org or ANNA.B7@X.EXAMPLE.ORG; +1 (017) 555-7713, +1-017-555-7713. Card 4111 1111 1111 1111, 4111111111111111! ip 10.0.30.255. 123-45-6789"),
        (2, "Dear Mrs. Anna Schmidt, meet Mr Jones. Later Schmidt and JONES left. Dr. Robin Lee."),
        (3, "Mr. Schmidt wrote to anna.b7@x.example.org."),
        (4, "Господин Иван Петров. Петров ушёл."),
    ]
    by = {r.doc_id: r for r in run(make_docs(rows, clash=True)).collect()}
    one = by[1].text
    mails = re.findall(r"[\w.]+@[\w.]+", one)
    assert mails[0].lower() == mails[1].lower().rstrip(".") and mails[1].isupper() and mails[0][0].isupper() and re.fullmatch(r"\w{4}\.\w\d@\w\.\w{7}\.org", mails[0])
    assert mails[0].lower() in by[3].text and "anna" not in one.lower()
    phones = re.search(r"\+1 \((\d{3})\) (\d{3})-(\d{4}), \+1-(\d{3})-(\d{3})-(\d{4})", one)
    assert phones and phones.groups()[:3] == phones.groups()[3:] and "".join(phones.groups()[:3]) != "0175557713"
    cards = re.search(r"Card ((?:\d{4} ){3}\d{4}), (\d{16})!", one)
    assert cards and cards[1].replace(" ", "") == cards[2] != "4111111111111111" and luhn(cards[2]) == luhn("4111111111111111")
    assert re.search(r"ip \d\d\.\d\.\d\d\.\d\d\d\.", one) and "123-45-6789" not in one and re.search(r" \d{3}-\d\d-\d{4}$", one)
    two = re.match(r"Dear Mrs\. (\w+) (\w+), meet Mr (\w+)\. Later (\w+) and (\w+) left\. Dr\. (\w+) (\w+)\.$", by[2].text)
    assert two and two[1] in surrogates.NAMES["latin", "f"].split() and two[2] == two[4] and two[3].upper() == two[5]
    assert f"Mr. {two[2]} wrote" in by[3].text
    four = re.match(r"Господин ([А-Я]\w+) ([А-Я]\w+)\. (\w+) ушёл\.$", by[4].text)
    assert four and four[2] == four[3] and four[1] in surrogates.NAMES["cyrillic", "m"].split() and four[1] != "Иван" or four


def test_clean_and_odd_rows_stay(make_docs, odd_docs):
    out = run(make_docs(odd_docs)).collect()
    assert sorted(((r.doc_id, r.text, r.n_mentions, r.kinds) for r in out), key=str) == sorted(((i, t, 0, "") for i, t in odd_docs), key=str)
    clean = [(1, "The The Of Of version 1.2.3 in 2024, 12:30, 3.14 and 1,000; a@b, @x, $5"), (2, "Mr. nobody, Anna, Robin goes")]
    assert sorted((r.doc_id, r.text) for r in run(make_docs(clean)).collect()) == clean


def test_repeated_rows_and_null_ids(make_docs):
    rows = [(7, "x@y.com"), (7, "x@y.com"), (7, "z@y.com"), (None, "x@y.com")]
    out = sorted(((r.doc_id, r.text) for r in run(make_docs(rows)).collect()), key=str)
    texts = {t for _, t in out}
    assert len(out) == 4 and len(texts) == 2 and not texts & {"x@y.com", "z@y.com"}


def test_a_hot_address_and_the_key(make_docs):
    rows = [(k, f"write to info@firm.example.com or u{k}@firm.example.com") for k in range(300)]
    a, b = (sorted((r.doc_id, r.text) for r in run(make_docs(rows), key).collect()) for key in ("one", "two"))
    words = [re.findall(r"\S+@\S+", t) for _, t in a]
    assert len({w[0] for w in words}) == 1 and len({w[1] for w in words} | {words[0][0]}) == 301 and a != b
    assert a == sorted((r.doc_id, r.text) for r in run(make_docs(rows), "one").collect())


def test_collisions_are_drawn_again(spark):
    few = [("name:m", f"n{k}") for k in range(300)] + [("ipv4", f"1.2.3.{k}") for k in range(10)] + [("email", f"{c}@{d}.com") for c in "abcdefghijkl" for d in "abcdefghijkl"]
    for rounds in (12, 1):
        out = surrogates.surrogate_map(spark.createDataFrame(few, "kind string, normal string"), "k", Workspace(spark, "test"), rounds).collect()
        assert sorted((r.kind, r.normal) for r in out) == sorted(few)
        assert len({(r.kind, r.surrogate) for r in out}) == len(few)
        assert not {(r.kind, r.surrogate) for r in out} & set(few)


def test_native_plan_and_empty_table(make_docs):
    out = run(make_docs([(1, "x@y.com")]))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert run(make_docs([])).collect() == [] and out.where(F.col("n_mentions") > 0).count() == 1
