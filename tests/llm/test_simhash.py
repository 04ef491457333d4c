import random

import xxhash

from glyphlake.llm.common import Workspace
from glyphlake.llm.components import connected_components
from glyphlake.llm.simhash import fingerprint, near_links, simhash_groups

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_fingerprint(text):
    words = [w for w in "".join(c if c not in " \t\n\v\f\r" else " " for c in (text or "").translate(LOWER)).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(values, bits=2):
    parent = {v: v for v in values}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    values = sorted(values)
    for k, a in enumerate(values):
        for b in values[k + 1 :]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= bits:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {v: root(v) for v in values}


def test_against_brute_force(make_docs, odd_docs):
    out = simhash_groups(make_docs(odd_docs, clash=True)).collect()
    fps = {t: slow_fingerprint(t) for _, t in odd_docs}
    groups = slow_groups(set(fps.values()))
    least: dict = {}
    for i, t in odd_docs:
        if i is not None:
            g = groups[fps[t]]
            least[g] = min(i, least.get(g, i))
    want = sorted(((i, f"{fps[t]:016x}", least.get(groups[fps[t]])) for i, t in odd_docs), key=str)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in out), key=str) == want
    assert fingerprint("A\xa0b\x85c") == slow_fingerprint("A\xa0b\x85c")


def test_crowded_keys_give_the_same_groups(spark):
    rnd = random.Random(9)
    base = [rnd.getrandbits(64) for _ in range(4)]
    values = {b for b in base} | {b ^ 1 << rnd.randrange(64) for b in base for _ in range(40)} | {b ^ 1 << rnd.randrange(64) ^ 1 << rnd.randrange(64) ^ 1 << rnd.randrange(64) for b in base for _ in range(60)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    want = slow_groups(signed)
    for hot in (1, 3, 1000):
        ws = Workspace(spark, "test")
        links = near_links(spark.createDataFrame([(v,) for v in signed], "fp long"), ws, 2, hot)
        got = {r.node: r.component for r in connected_components(links.selectExpr("x as a", "y as b"), ws).collect()}
        assert {v: got.get(v, v) for v in signed} == want


def test_long_chain_of_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(1000, 1001), (1001, 1000)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges, Workspace(spark, "test")).collect()}
    assert got == {k: 0 for k in range(1, 201)} | {1001: 1000}


def test_empty_table(make_docs):
    assert simhash_groups(make_docs([])).collect() == []
