import zlib

from glyphlake.llm.sharding import shard_by_bytes


def check(rows, out, shards):
    size = lambda t: len((t or "").encode()) + 1
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in out), key=str) == sorted(((i, size(t), zlib.crc32((t or "").encode())) for i, t in rows), key=str)
    order = sorted(out, key=lambda r: (r.shard, r.slot))
    for s in range(shards):
        assert [r.slot for r in order if r.shard == s] == list(range(sum(r.shard == s for r in order)))
    ids = [-1 if r.doc_id is None else r.doc_id for r in order]
    assert ids == sorted(ids)  # contiguous
    total, at = sum(r.size for r in out), 0
    for r in order:  # every row lies where its middle byte falls
        assert r.shard == min(shards - 1, (at * 2 + r.size) * shards // (2 * total))
        at += r.size


def test_against_prefix_sums(make_docs, odd_docs):
    check(odd_docs, shard_by_bytes(make_docs(odd_docs, clash=True), shards=4, partitions=8).collect(), 4)


def test_one_hot_id_and_many_nulls(make_docs):
    rows = [(5, f"t{k % 40}") for k in range(300)] + [(None, f"u{k}") for k in range(100)] + [(k, "x" * k) for k in range(50)]
    check(rows, shard_by_bytes(make_docs(rows), shards=16, partitions=16).collect(), 16)


def test_empty_table(make_docs):
    assert shard_by_bytes(make_docs([]), shards=16).collect() == []


def test_plan_has_no_python(make_docs, odd_docs):
    plan = shard_by_bytes(make_docs(odd_docs))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
