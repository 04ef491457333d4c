import random

import pytest

#: Columns whose names clash with what the operators compute; every operator must ignore them.
CLASH = ", fp long, spans string, length int, shard int, n_words int, at long, id long, name string, rk long, text_crc32 int, host string, `group` string"
CLASH_ROW = (1, "x", 2, 3, 4, 5, 6, "y", 7, 8, "h", "g")


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows, schema="doc_id long, text string", clash=False):
        if clash:
            rows, schema = [(*r, *CLASH_ROW) for r in rows], schema + CLASH
        return spark.createDataFrame(rows, schema)

    return make


@pytest.fixture(scope="session")
def odd_docs():
    """Nulls, empty and very long texts, ties, repeated rows, one hot group of copies."""
    rnd = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    long, hot, passage = text(6000), text(80), text(60)
    rows = [(1, None), (2, ""), (3, "   \n\t"), (4, long), (5, long + " tail"), (6, "one"), (7, "one two"), (8, "É À ç"), (9, long), (9, long), (None, "no id"), (None, None), (10, text(55))]
    rows += [(20 + k, hot) for k in range(40)]
    rows += [(100 + k, text(30) + " " + passage + " " + text(30)) for k in range(15)]
    rows += [(200 + k, hot + f" x{k}") for k in range(8)]
    rows += [(300, "the " * 400), (301, "a " + "the " * 300 + "b"), (302, ("p q r " * 60).strip())]
    return rows
