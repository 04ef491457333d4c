"""Near-duplicate vectors within a label: one small-world graph per shard, every shard queried, links verified.

Equal vectors of a label are merged first and carry their number, so a group of copies of any size is one node. A label
with more than ``cap`` distinct vectors is spread over several shards by hash; each shard's graph is built in one task and
stored. Queries go to every shard of their label in blocks of bounded size. In each block a hashed twentieth of the
queries (at least 32) is compared with the whole shard by brute force, and ever more of them until ``LINKED`` have a link
to another vector; a block with fewer is thereby searched exactly as a whole. The beam is doubled until the share of their
links, without themselves, that the graph finds reaches ``recall``, over all links and on average over these queries.
Candidates are verified in double precision.

A block returns the number of links of each vector, and of the links themselves only as many as join what they join.

Defined results: vectors that are null, zero, or hold a null or a non-finite component, and rows with a null label, have
no links and are their own component; vectors of different length do not link; repeated rows count as vectors of their
own; rows with a null id keep it and link with nothing; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from glyphlake.llm.common import Workspace
from glyphlake.llm.components import connected_components
from glyphlake.llm.hnsw import Index

LINKED = 100
_SLACK = 1e-5  # the graph works in single precision


def _levels(ids: np.ndarray, width: int) -> np.ndarray:
    """Layer of each node from a hash of its id, geometric with ratio 1 / width."""
    x = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    for _ in range(2):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    u = ((x >> np.uint64(11)).astype(np.float64) + 1) / 2.0**53
    return np.minimum((-np.log(u) / np.log(width)).astype(np.int64), 6)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _exact(unit: np.ndarray, q: np.ndarray, least: float, block: int = 256) -> list[np.ndarray]:
    return [np.flatnonzero(row >= least) for k in range(0, len(q), block) for row in q[k : k + block] @ unit.T]


def audited(
    index: Index, unit: np.ndarray, q: np.ndarray, order: np.ndarray, least: float, recall: float, ef: int, reps: np.ndarray, mine: np.ndarray
) -> list[np.ndarray]:
    """For each query the verified nodes with cosine >= least, without itself (nodes are named ``reps``, queries ``mine``).

    Queries are audited in the order given until LINKED of them have links; then the beam is doubled until the audit passes.
    """

    def others(hits: list[np.ndarray], at: np.ndarray) -> list[np.ndarray]:
        return [h[reps[h] != me] for h, me in zip(hits, mine[at], strict=True)]

    def found(at: np.ndarray, beam: int) -> list[np.ndarray]:
        return others([c[(unit[c] @ v) >= least] for c, v in zip(index.near(q[at], least - _SLACK, beam), q[at], strict=True)], at)

    out: dict[int, np.ndarray] = {}
    upto = max(32, len(q) // 20)
    while len(out) < len(q) and sum(len(t) > 0 for t in out.values()) < LINKED:
        at = order[len(out) : upto]
        out.update(zip(at.tolist(), others(_exact(unit, q[at], least), at), strict=True))
        upto *= 2
    rest = order[len(out) :]
    if len(rest):
        linked = np.array([k for k, t in out.items() if len(t)])
        want = np.array([len(out[k]) for k in linked])
        while ef < len(unit):
            got = np.array([len(np.intersect1d(out[k], f)) for k, f in zip(linked, found(linked, ef), strict=True)])
            if got.sum() >= recall * want.sum() and (got / want).mean() >= recall:
                break
            ef *= 2
        out.update(zip(rest.tolist(), found(rest, ef) if ef < len(unit) else others(_exact(unit, q[rest], least), rest), strict=True))
    return [out[k] for k in range(len(q))]


def link_vectors(
    vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", cap: int = 8192,
    width: int = 16, ef: int = 32, recall: float = 0.98,
) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    ws = Workspace(spark, "vectors")
    vec = F.col(vector_col)
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(vec, lambda x: x != 0)
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"),
        F.when(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & vec.isNotNull() & fine, F.concat_ws(":", F.size(vec), F.col(label_col).cast("string"))).alias("group"),
        F.transform(vec, lambda x: x.cast("double")).alias("v"),
    )
    good = rows.where("group is not null")
    nodes = good.groupBy("group", "v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    nodes = ws.save(nodes.withColumn("node", F.xxhash64("group", "v", "rep")), "nodes")
    sizes = nodes.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cap)
    sizes = sizes.select("group", F.ceil(F.col("n") / cap).cast("int").alias("shards"), F.ceil(F.col("n") / (4 * cap)).cast("int").alias("blocks"))
    nodes = ws.save(
        nodes.join(sizes, "group", "left")
        .withColumns({"shards": F.coalesce("shards", F.lit(1)), "blocks": F.coalesce("blocks", F.lit(1))})
        .withColumns({"shard": F.pmod("node", "shards").cast("int"), "block": F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")}),
        "sharded",
    )

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["node", "rep"])
        unit = _unit(np.stack(part["v"].to_numpy()))
        index = Index(unit, _levels(part["node"].to_numpy(), width), width)
        return pd.DataFrame(
            {"group": [part["group"].iloc[0]], "shard": [part["shard"].iloc[0]], "blocks": [part["blocks"].iloc[0]], "graph": [index.dump()], "unit": [unit.tobytes()],
             "reps": [part["rep"].to_numpy().tobytes()], "copies": [part["copies"].to_numpy().tobytes()]}
        )

    graphs = nodes.groupBy("group", "shard").applyInPandas(build, "group string, shard int, blocks int, graph binary, unit binary, reps binary, copies binary")
    graphs = ws.save(graphs, "graphs")

    def query(q: pd.DataFrame, graph: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(graph):
            return pd.DataFrame({"id": [], "links": [], "other": []}).astype("int64")
        index, one = Index.load(graph["graph"].iloc[0]), graph.iloc[0]
        reps, copies = np.frombuffer(one["reps"], dtype=np.int64), np.frombuffer(one["copies"], dtype=np.int64)
        unit = np.frombuffer(one["unit"], dtype=np.float64).reshape(len(reps), -1)
        q = q.sort_values(["node", "rep"])
        mine = q["rep"].to_numpy()
        order = np.argsort(q["node"].to_numpy().astype(np.uint64) % np.uint64(1009), kind="stable")
        found = audited(index, unit, _unit(np.stack(q["v"].to_numpy())), order, least, recall, ef, reps, mine)
        label = np.arange(len(reps))
        out: list[tuple[int, int, int]] = []
        for me, other in zip(mine.tolist(), found, strict=True):
            out.append((me, int(copies[other].sum()), me))
            if len(other):
                groups, first = np.unique(label[other], return_index=True)
                out += [(me, 0, int(r)) for r in reps[other[first]]]
                if len(groups) > 1:
                    label[np.isin(label, groups)] = groups[0]
        return pd.DataFrame(out, columns=["id", "links", "other"])

    asked = nodes.select("group", "node", "rep", "v", "block", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    served = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = ["group", "shard", "block"]
    answers = ws.save(asked.groupBy(*keys).cogroup(served.groupBy(*keys)).applyInPandas(query, "id long, links long, other long"), "answers")
    linked = connected_components(answers.where("id <> other").select(F.col("id").alias("a"), F.col("other").alias("b")), ws)
    links = answers.groupBy("id").agg(F.sum("links").alias("links")).select(F.col("id").alias("rep"), "links")
    known = nodes.select(F.col("group").alias("g"), F.col("v").alias("w"), "rep", "copies").join(links, "rep")
    known = known.join(linked, F.col("rep") == F.col("node"), "left").select("g", "w", "rep", "copies", "links", "component")
    out = rows.join(known, (F.col("group") == F.col("g")) & (F.col("v") == F.col("w")), "left")
    component = F.coalesce("component", "rep", "id")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce(F.col("copies") - 1 + F.col("links"), F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        (F.col("id") == component).alias("kept"),
    )


