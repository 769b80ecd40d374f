"""Approximate nearest neighbours by learned partitions.

On a bounded sample (at most `SAMPLE_ROWS` vectors, those with the smallest hash of the id) the graph of nearest
neighbours is cut into parts of equal size by recursive bisection, and a softmax classifier learns
which part a vector belongs to. The classifier places every vector of the table in its most probable part,
and sends each query to its several most probable parts, where all vectors are scored exactly. How
many parts a query visits is the smallest number that reaches `TARGET_RECALL` on the sample.

A part is split into blocks of bounded size, so a part with most of the rows (many copies of one vector)
is many tasks; queries are copied to the blocks of the parts they visit.

Defined results: vectors that are NULL, empty, zero or hold NULL or non-finite components, rows with
a NULL id and vectors whose length is not the most frequent one (the shorter, on a tie) take no part; an id
that occurs several times stands for all its vectors and a pair's score is the best of them; ties go to the
smaller id; a query with fewer candidates than `k` gets all; an empty table gives no rows.
Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.session import materialize

K = 5
SAMPLE_ROWS = 4096
PARTS = 16
GRAPH_DEGREE = 10
BLOCK_ROWS = 8192
TARGET_RECALL = 0.97


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def neighbour_graph(x: np.ndarray, degree: int) -> np.ndarray:
    """The `degree` nearest other rows of each row."""
    found = []
    for first in range(0, len(x), 512):
        near = x[first : first + 512] @ x.T
        near[np.arange(len(near)), first + np.arange(len(near))] = -np.inf
        found.append(np.argpartition(-near, degree - 1, axis=1)[:, :degree])
    return np.concatenate(found)


def bisect(nodes: np.ndarray, edges: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Halves of `nodes` that cut few edges: second eigenvector of the graph's random walk, split at its median."""
    place = np.full(int(edges.max(initial=0)) + 1 + int(nodes.max(initial=0)), -1)
    place[nodes] = np.arange(len(nodes))
    inside = edges[(place[edges[:, 0]] >= 0) & (place[edges[:, 1]] >= 0)]
    a, b = place[inside[:, 0]], place[inside[:, 1]]
    degree = np.bincount(a, minlength=len(nodes)) + np.bincount(b, minlength=len(nodes)) + 1.0
    v = rng.standard_normal(len(nodes))
    for _ in range(60):
        v -= (v * degree).sum() / degree.sum()
        spread = v + np.bincount(a, v[b], minlength=len(nodes)) + np.bincount(b, v[a], minlength=len(nodes))
        v = v + spread / degree
        v /= np.abs(v).max() + 1e-300
    order = np.argsort(v, kind="stable")
    half = len(nodes) // 2
    return nodes[order[:half]], nodes[order[half:]]


def balanced_parts(x: np.ndarray, parts: int, seed: int = 42) -> np.ndarray:
    rng = np.random.default_rng(seed)
    near = neighbour_graph(x, min(GRAPH_DEGREE, len(x) - 1)) if len(x) > 1 else np.zeros((len(x), 0), int)
    edges = np.stack([np.repeat(np.arange(len(x)), near.shape[1]), near.ravel()], axis=1)
    groups = [np.arange(len(x))]
    while len(groups) < parts:
        groups = [half for g in groups for half in bisect(g, edges, rng)]
    label = np.zeros(len(x), int)
    for k, group in enumerate(groups):
        label[group] = k
    return label


def fit_router(x: np.ndarray, label: np.ndarray, parts: int, steps: int = 300) -> np.ndarray:
    """Softmax regression from unit vectors (and a constant) to parts; Adam on all rows."""
    inputs = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros((inputs.shape[1], parts))
    m, v = np.zeros_like(w), np.zeros_like(w)
    hot = np.eye(parts)[label]
    for t in range(1, steps + 1):
        p = inputs @ w
        p = np.exp(p - p.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = inputs.T @ (p - hot) / len(x) + 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def ranking(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Parts of each unit vector, most probable first."""
    return np.argsort(-(x @ w[:-1] + w[-1]), axis=1, kind="stable")


def fit(x: np.ndarray, parts: int, k: int, target: float) -> tuple[np.ndarray, int]:
    """Router and number of parts to visit, from a sample of vectors."""
    x = _unit(x)
    while parts > 1 and len(x) < parts * 64:
        parts //= 2
    w = fit_router(x, balanced_parts(x, parts), parts)
    order = ranking(x, w)
    if parts == 1 or len(x) <= k:
        return w, parts
    nearest = neighbour_graph(x, k)
    rank_of = np.argsort(order, axis=1)
    # Position, in the query's own order, of the part each true neighbour is stored in.
    needed = np.take_along_axis(rank_of, order[:, 0][nearest], axis=1) + 1
    for visits in range(1, parts + 1):
        if (needed <= visits).mean() >= target:
            return w, visits
    return w, parts


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    given = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("vector"))
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return given.filter(
        F.col("id").isNotNull() & F.coalesce(F.forall("vector", fine) & F.exists("vector", lambda c: c != 0), F.lit(False))
    )


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def score_block(k: int, dim: int):
    """The k nearest of one block's vectors for each query sent there."""

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if rows.num_rows and queries.num_rows:
            ids, x = rows.column("id").to_numpy(), _matrix(rows.column("vector"), dim)
            asked, q = queries.column("query").to_numpy(), _matrix(queries.column("vector"), dim)
            size, q_size = np.sqrt((x * x).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
            for first in range(0, len(q), 64):
                near = (q[first : first + 64] @ x.T) / size / q_size[first : first + 64, None]
                near[asked[first : first + 64, None] == ids] = -np.inf
                best = min(k, near.shape[1])
                edge = np.partition(near, near.shape[1] - best, axis=1)[:, near.shape[1] - best]
                for r in range(len(near)):
                    at = np.flatnonzero((near[r] >= edge[r] - 1e-9) & (near[r] > -np.inf))
                    j = first + r
                    # Equal vectors get equal scores here, whatever their place in the block.
                    exact = (x[at] * q[j]).sum(axis=1) / (size[at] * q_size[j])
                    at_id, at_score = _best(ids[at], exact, k)
                    out.append((np.full(len(at_id), asked[j]), at_id, at_score))
        query, near_id, score = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, int),) * 2 + (np.zeros(0),)
        return pa.table({"query": pa.array(query, pa.int64()), "id": pa.array(near_id, pa.int64()), "score": pa.array(score, pa.float64())})

    return run


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best different ids, ties to the smaller."""
    order = np.lexsort((ids, -scores))
    _, first = np.unique(ids[order], return_index=True)
    order = order[np.sort(first)][:k]
    return ids[order], scores[order]


def nearest(
    vectors: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = K,
    parts: int = PARTS,
    sample_rows: int = SAMPLE_ROWS,
    target_recall: float = TARGET_RECALL,
) -> DataFrame:
    """(query_id, rank, id, score) of the `k` nearest others of every row with `is_query` (a condition on `id`)."""
    spark = vectors.sparkSession
    usable = _usable(vectors, id_col, vector_col)
    length = usable.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = length["dim"] if length else 1
    usable = usable.filter(F.size("vector") == dim)
    sample = usable.orderBy(F.xxhash64("id"), "id", "vector").limit(sample_rows)

    def fit_sample(rows: pd.DataFrame) -> pd.DataFrame:
        w, visits = fit(np.stack(rows["vector"].to_numpy()), parts, k, target_recall)
        return pd.DataFrame({"w": [w.tobytes()], "parts": [w.shape[1]], "visits": [visits]})

    model = sample.groupBy().applyInPandas(fit_sample, "w binary, parts int, visits int").first()
    if model is None:
        w, visits = np.zeros((dim + 1, 1)), 1
    else:
        w, visits = np.frombuffer(model["w"]).reshape(dim + 1, model["parts"]), model["visits"]
    router = spark.sparkContext.broadcast(w)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vector"), dim)
            part = ranking(_unit(x), router.value)[:, 0] if len(x) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part.astype(np.int32))], names=["id", "vector", "part"])

    placed = materialize(usable.mapInArrow(place, "id long, vector array<double>, part int"), "placed")
    # One row per part, whatever the table holds.
    counts = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}
    held = spark.sparkContext.broadcast(np.array([counts.get(p, 0) for p in range(w.shape[1])]))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vector"), dim)
            if not len(x):
                continue
            order = ranking(_unit(x), router.value)
            rows_before = np.cumsum(held.value[order], axis=1) - held.value[order]
            # Further parts while those before hold too few rows for k others than the query itself.
            visited = (np.arange(order.shape[1]) < visits) | (rows_before <= 4 * k)
            row, at = np.nonzero(visited & (held.value[order] > 0))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(row)),
                    batch.column("vector").take(pa.array(row)),
                    pa.array(order[row, at].astype(np.int32)),
                ],
                names=["query", "vector", "part"],
            )

    blocks = F.create_map(*[F.lit(v) for p in sorted(counts) for v in (p, -(-counts[p] // BLOCK_ROWS))]) if counts else F.create_map(F.lit(0), F.lit(1))
    queries = placed.filter(is_query).select("id", "vector").mapInArrow(route, "query long, vector array<double>, part int")
    sent = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.element_at(blocks, F.col("part")) - 1)))
    stored = placed.withColumn("block", F.pmod(F.xxhash64("id", "vector"), F.element_at(blocks, F.col("part"))).cast("int"))
    found = (
        stored.groupBy("part", "block")
        .cogroup(sent.groupBy("part", "block"))
        .applyInArrow(score_block(k, dim), "query long, id long, score double")
    )
    best = found.groupBy("query", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        F.col("query").alias("query_id"), "rank", F.col("id").alias(id_col), "score"
    )
