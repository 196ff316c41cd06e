"""Nearest neighbours by a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample (``SAMPLE`` vectors in hash order): k-means splits a node into ``BRANCH``
children until it holds at most ``LEAF`` of them, so nodes are bounded too and the tree is broadcast. Every vector
goes down to one leaf. A query walks the tree by a priority queue: the node with the nearest centre is opened
next, and leaves come out in that order. How many leaves to visit is calibrated: for ``CALIBRATE`` vectors of the
corpus the true neighbours are computed over all rows, and the visits are widened until the visited leaves hold
``RECALL`` of them.

Leaves are cut into blocks of about ``BLOCK_ROWS`` rows, and the queries of a leaf into as many, so that a leaf with
a third of all rows, or one that all queries visit, is many tasks. Blocks give their own nearest, found by exact
distances in double precision, and a query's best of those are ranked. A block keeps k ids, not rows, and the rows of
one id are dealt to all blocks of their leaf.

Cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, neither do those of
another length than most of the sample; rows that repeat an id are all searched, and an id is listed once, by its
nearest row; ties go to the smaller id; fewer candidates than k give fewer rows; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, col

SAMPLE, BRANCH, LEAF = 20_000, 8, 100
CALIBRATE, RECALL = 200, 0.96
BLOCK_ROWS = 4096


def valid(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)


@dataclass
class Tree:
    centres: np.ndarray  # node x dimension
    children: list[list[int]]  # empty for a leaf

    def leaves_of(self, vectors: np.ndarray) -> np.ndarray:
        """Every vector's leaf: at each node the nearest child."""
        at = np.zeros(len(vectors), np.int64)
        open_ = {0: np.arange(len(vectors))}
        while open_:
            node, rows = open_.popitem()
            kids = np.array(self.children[node])
            if not len(kids):
                at[rows] = node
                continue
            near = kids[_squares(vectors[rows], self.centres[kids]).argmin(axis=1)]
            open_.update((int(k), rows[near == k]) for k in kids if (near == k).any())
        return at

    def best_first(self, query: np.ndarray, visits: int) -> list[int]:
        """The first ``visits`` leaves in the order of the queue."""
        queue, out = [(0.0, 0)], []
        while queue and len(out) < visits:
            node = heapq.heappop(queue)[1]
            kids = self.children[node]
            if not kids:
                out.append(node)
                continue
            for d, k in zip(_squares(query[None, :], self.centres[kids])[0].tolist(), kids, strict=True):
                heapq.heappush(queue, (d, k))
        return out


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def fit_tree(sample: np.ndarray, branch: int = BRANCH, leaf: int = LEAF, rounds: int = 8, seed: int = 1) -> Tree:
    rng = np.random.default_rng(seed)
    centres, children = [sample.mean(axis=0)], [[]]
    open_ = [(0, np.arange(len(sample)))]
    while open_:
        node, rows = open_.pop()
        points = sample[rows]
        if len(rows) <= leaf or (points == points[0]).all():
            continue
        means = points[rng.choice(len(rows), min(branch, len(rows)), replace=False)]
        for _ in range(rounds):
            near = _squares(points, means).argmin(axis=1)
            means = np.array([points[near == k].mean(axis=0) if (near == k).any() else means[k] for k in range(len(means))])
        near = _squares(points, means).argmin(axis=1)
        groups = [rows[near == k] for k in range(len(means)) if (near == k).any()]
        if len(groups) < 2:
            continue
        for group in groups:
            children[node].append(len(centres))
            centres.append(sample[group].mean(axis=0))
            children.append([])
            open_.append((len(centres) - 1, group))
    return Tree(np.array(centres), children)


def nearest(queries: np.ndarray, own: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, rows, distances) of the k nearest ids by (distance, id), each by its nearest row, the query's own id left out."""
    # rows by id, so that each id's are side by side
    by_id = np.argsort(ids, kind="stable")
    ids, rows = ids[by_id], rows[by_id]
    starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    for low in range(0, len(queries), 256):
        part = queries[low:low + 256]
        rough = _squares(part, rows)
        scale = 1e-9 * (1 + (part * part).sum(1) + (rows * rows).sum(1).max(initial=0))
        for i, q in enumerate(part):
            d = np.where(ids == own[low + i], np.inf, rough[i])
            if len(starts) > k:
                least = np.minimum.reduceat(d, starts)
                d = np.where(d <= np.partition(least, k - 1)[k - 1] + scale[i], d, np.inf)
            pick = np.flatnonzero(np.isfinite(d))
            exact = np.sqrt(((rows[pick] - q) ** 2).sum(axis=1))
            order = np.lexsort((ids[pick], exact))
            order = order[np.sort(np.unique(ids[pick][order], return_index=True)[1])][:k]
            yield low + i, by_id[pick[order]], exact[order]


def _matrix(column, dim: int) -> np.ndarray:
    """An Arrow list column of ``dim`` numbers each."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(values.flatten(), np.float64).reshape(-1, dim)


def _true_neighbours(rows: DataFrame, probes: np.ndarray, probe_ids: np.ndarray, dim: int, tree, k: int) -> np.ndarray:
    """(probe, leaf) of the true nearest over all rows, with the leaf the neighbour is stored in."""
    shared = rows.sparkSession.sparkContext.broadcast((probes, probe_ids))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes, probe_ids = shared.value
        for batch in batches:
            ids, at = batch.column("id").to_numpy(), batch.column("leaf").to_numpy()
            found = [(p, i, d, leaf) for p, n, ds in nearest(probes, probe_ids, ids, _matrix(batch.column("v"), dim), k)
                     for i, d, leaf in zip(ids[n].tolist(), ds.tolist(), at[n].tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({n: [f[j] for f in found] for j, n in enumerate(("probe", "id", "d", "leaf"))},
                                             pa.schema([("probe", pa.int64()), ("id", pa.int64()), ("d", pa.float64()), ("leaf", pa.int64())]))

    found = rows.mapInArrow(best, "probe long, id long, d double, leaf long")
    found = found.groupBy("probe", "id").agg(F.min(F.struct("d", "leaf")).alias("m")).select("probe", "id", "m.d", "m.leaf")
    ranked = found.withColumn("r", F.row_number().over(Window.partitionBy("probe").orderBy("d", "id"))).filter(F.col("r") <= k)
    return np.array([(r["probe"], r["leaf"]) for r in ranked.select("probe", "leaf").collect()], np.int64).reshape(-1, 2)


def calibrated_visits(tree: Tree, probes: np.ndarray, truth: np.ndarray, recall: float = RECALL) -> tuple[int, float]:
    """The fewest visits that reach the recall on the probes, and the recall they reach."""
    if not len(truth):
        return 1, 1.0
    place = np.array([{leaf: i for i, leaf in enumerate(tree.best_first(probes[p], len(tree.children)))}[leaf]
                      for p, leaf in truth.tolist()])
    visits = 1
    while (got := (place < visits).mean()) < recall:
        visits += 1
    return visits, float(got)


def search(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10,
           recall: float = RECALL, sample: int = SAMPLE, probes: int = CALIBRATE) -> DataFrame:
    """Per query (a row of ``df`` that ``is_query`` picks) and rank: query_id, rank, id, score (distance)."""
    spark = df.sparkSession
    scratch = Scratch(spark, "tree")
    schema = f"query_id long, rank int, `{id_col}` long, score double"
    good = df.filter(valid(col(vector_col)) & col(id_col).isNotNull()).select(
        col(id_col).cast("long").alias("id"), col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    n = good.count()
    slot = F.pmod(F.xxhash64("id", "v"), F.lit(1 << 20))
    share = min(1 << 20, int((1 << 20) * 1.2 * sample / max(n, 1)) + 1)
    picked = good.filter(slot < share).select("id", "v").distinct().orderBy(F.xxhash64("id", "v"), "id").limit(sample).toPandas()
    if not len(picked):
        return spark.createDataFrame([], schema)
    dim = int(pd.Series(picked.v.map(len)).mode()[0])
    picked = picked[picked.v.map(len) == dim]
    points = np.array(picked.v.tolist(), np.float64)
    tree = fit_tree(points)
    shared = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = shared.value.leaves_of(_matrix(batch.column("v"), dim))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], ["id", "v", "q", "leaf"])

    rows = good.filter(F.size("v") == dim).mapInArrow(place, "id long, v array<double>, q boolean, leaf long")
    # a number per row, by which copies of a row go to different blocks too
    rows = scratch.store(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    few = np.linspace(0, len(points) - 1, min(probes, len(points))).astype(int)
    truth = _true_neighbours(rows, points[few], picked.id.to_numpy()[few], dim, tree, k)
    visits, _ = calibrated_visits(tree, points[few], truth, recall)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column("v"), dim)
            leaves = [shared.value.best_first(q, visits) for q in vectors]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaves, pa.list_(pa.int64()))], ["id", "v", "row", "leaves"])

    asked = scratch.store(rows.filter("q").select("id", "v", "row").mapInArrow(walk, "id long, v array<double>, row long, leaves array<long>")
                          .select("id", "v", "row", F.explode("leaves").alias("leaf")), "asked")
    # a row per leaf, at most the nodes of the tree
    cuts = rows.groupBy("leaf").agg(F.count("*").alias("n")).join(
        asked.groupBy("leaf").agg(F.count("*").alias("m")), "leaf").select(
        "leaf", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks"), F.ceil(F.col("m") / BLOCK_ROWS).cast("int").alias("parts"))
    cuts = F.broadcast(scratch.store(cuts, "cuts"))
    left = asked.join(cuts, "leaf").select("leaf", "id", "v", F.pmod(F.xxhash64("id", "row"), "parts").cast("int").alias("part"),
                                           F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    right = rows.join(cuts, "leaf").select("leaf", "id", "v", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
                                           F.pmod(F.xxhash64("id", "row"), "blocks").cast("int").alias("block"))

    def compare(asked: pa.Table, rows: pa.Table) -> pa.Table:
        if not asked.num_rows or not rows.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        own, ids = asked.column("id").to_numpy(), rows.column("id").to_numpy()
        found = list(nearest(_matrix(asked.column("v"), dim), own, ids, _matrix(rows.column("v"), dim), k))
        return pa.table({"query_id": np.concatenate([np.full(len(i), own[q]) for q, i, _ in found]),
                         "id": np.concatenate([ids[i] for _, i, _ in found]), "score": np.concatenate([d for _, _, d in found])})

    keys = ["leaf", "block", "part"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "query_id long, id long, score double")
    near = near.groupBy("query_id", "id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    best = near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), F.col("id").alias(id_col), "score")
    out = scratch.store(best, "result", result=True)
    scratch.clear()
    return out
