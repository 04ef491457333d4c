import random

import numpy as np

from glyphlake.llm.hnsw import Index
from glyphlake.llm.vectors import _levels, audited, link_vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, least=0.98):
    def ok(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    links = {k: [] for k in range(len(rows))}
    for a in range(len(rows)):
        for b in range(a):
            (i, u, x), (j, v, y) = rows[a], rows[b]
            if x is None or x != y or i is None or j is None or not ok(u) or not ok(v) or len(u) != len(v):
                continue
            u, v = (np.array(w, dtype=np.float32).astype(np.float64) for w in (u, v))
            if u @ v / np.sqrt((u @ u) * (v @ v)) >= least:
                links[a].append(b)
                links[b].append(a)
    out = []
    for k, (i, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for n in links[todo.pop()]:
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        least_id = min((rows[n][0] for n in seen if rows[n][0] is not None), default=None)
        out.append((i, len(links[k]), least_id))
    return sorted(out, key=str)


def sample(seed=1):
    rnd = random.Random(seed)
    gauss = lambda s=1.0: [rnd.gauss(0, s) for _ in range(12)]
    rows, n = [], 0
    for label in range(3):
        for _ in range(12):
            base = gauss()
            for _ in range(rnd.randint(1, 8)):
                rows.append((n, [float(np.float32(a + b)) for a, b in zip(base, gauss(0.06), strict=True)], label))
                n += 1
    hot = rows[0][1]
    rows += [(n + k, hot, 0) for k in range(50)] + [(n + 60 + k, hot, None if k % 2 else 2) for k in range(6)]
    odd = [None, [], [0.0] * 12, [1.0] * 11 + [None], [1.0] * 11 + [float("nan")], [float("inf")] * 12, [1.0], [2.0]]
    rows += [(2000 + k, v, 0) for k, v in enumerate(odd)] + [(None, hot, 0), (5, hot, 0)]
    return rows


def test_against_brute_force(spark):
    rows = sample()
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", node long, copies int")
    for cap in (8192, 30):  # one shard a label, several
        out = link_vectors(docs, cap=cap).collect()
        got = sorted(((r.vec_id, r.n_links, r.component_id) for r in out), key=str)
        want = brute(rows)
        found, there = sum(x[1] for x in got), sum(x[1] for x in want)
        assert len(got) == len(want) and there * 0.95 <= found <= there
        assert sum(a == b for a, b in zip(got, want, strict=True)) >= 0.95 * len(want)
        assert all(r.kept == (r.vec_id == r.component_id) for r in out if r.vec_id is not None)


def test_recall_of_the_graph():
    rng = np.random.default_rng(0)
    base = rng.normal(size=(300, 32))
    x = (base[:, None, :] + 0.1 * rng.normal(size=(300, 10, 32))).reshape(-1, 32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = Index.load(Index(x, _levels(np.arange(len(x)), 16)).dump())
    truth = x @ x.T >= 0.98
    found = index.near(x, 0.98, 32)
    assert sum(truth[k][np.unique(f)].sum() for k, f in enumerate(found)) >= 0.95 * truth.sum()


class Blind:
    """An index that finds nothing but the query itself."""

    def __init__(self, x):
        self.x = x

    def near(self, q, least, ef):
        return [np.array([int(np.argmax(self.x @ v))]) for v in q]


def test_audit_does_not_count_a_vector_s_match_with_itself():
    rng = np.random.default_rng(3)
    for pairs in (15, 1000):  # links too few to judge by, and enough
        x = rng.normal(size=(2000, 24))
        x[:pairs] = x[1000 : 1000 + pairs] + 0.01 * rng.normal(size=(pairs, 24))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        names = np.arange(len(x)) + 7
        found = audited(Blind(x), x, x, rng.permutation(len(x)), 0.98, 0.98, 32, names, names)
        assert [k for k, f in enumerate(found) if len(f)] == [*range(pairs), *range(1000, 1000 + pairs)]
        assert all(f.tolist() == [(k + 1000) % 2000] for k, f in enumerate(found) if len(f))
        graph = audited(Index(x, _levels(names, 16)), x, x, rng.permutation(len(x)), 0.98, 0.98, 32, names, names)
        assert sum(map(len, graph)) >= 0.98 * 2 * pairs


def test_tiny_indexes():
    for n in (1, 2, 3):
        x = np.eye(4)[:n]
        found = Index(x, np.zeros(n, dtype=np.int64)).near(x, 0.9, 8)
        assert [f.tolist() for f in found] == [[k] for k in range(n)]


def test_empty_table(spark):
    assert link_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
