"""Nearest neighbours by inner product through an inverted multi-index.

Vectors are cut into two halves, each quantised by its own codebook of ``CENTROIDS`` centroids; a pair of centroids is a cell of
the index. An inner product is the sum of those of the halves, so the nearness of a query to a cell is the sum of two numbers.
A query walks the pairs from the largest sum down with a heap (multi-sequence order) until the cells it has met hold its share of
all vectors, and the vectors of those cells are ranked by their exact inner products.

* The codebooks, and the share to visit, are fitted on a bounded sample of ``SAMPLE_ROWS`` vectors chosen by hash of vec_id. The share
  is the smallest that reaches ``TARGET`` of the true neighbours of sample queries: small if vectors cluster, large if they lie
  evenly (as they do here; see the README for the measured recall).
* Every vector is indexed. Equal vectors are one entry that carries its smallest ids, one more than are asked for, which is
  all that a result can need; so a vector with very many copies does not fill a cell.
* Cells are dealt to shards of at most ``SHARD_ROWS`` entries, large cells over several; queries go in blocks of ``BLOCK_QUERIES`` to
  the shards that hold their cells. A task holds one shard and one block. Only the best of each shard meet in the final ranking.

Rows and edge cases: vectors that are null, zero, or hold null, NaN or infinite values take no part, nor do rows without a vec_id or
of another length than most; ties go to the smaller vec_id; rows that repeat both id and vector count once; an id with several
vectors is ranked by each and is never its own neighbour. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftnet.session import checkpointed

CENTROIDS, SAMPLE_ROWS, TARGET = 64, 8192, 0.97
SHARD_ROWS, BLOCK_QUERIES = 20_000, 2_000


@dataclass(frozen=True)
class Index:
    """Codebooks of the halves, entries per cell, and the share of the entries that a query visits."""

    left: np.ndarray
    right: np.ndarray
    share: float
    counts: np.ndarray | None = None

    def cells(self, x: np.ndarray) -> np.ndarray:
        half = self.left.shape[1]
        return _nearest(x[:, :half], self.left) * len(self.right) + _nearest(x[:, half:], self.right)

    def walk(self, query: np.ndarray) -> list[int]:
        """Cells with entries in order of the summed inner products, until they hold the share."""
        half = self.left.shape[1]
        a, b = self.left @ query[:half], self.right @ query[half:]
        first, second = np.argsort(-a, kind="stable").tolist(), np.argsort(-b, kind="stable").tolist()
        a, b = a[first].tolist(), b[second].tolist()
        want, width, counts = self.share * self.counts.sum(), len(b), self.counts
        met, found = 0, []
        heap = [(-(a[0] + b[0]), 0, 0)]
        while heap and met < want:
            _, i, j = heapq.heappop(heap)
            # (i, j + 1) is pushed by (i, j); (i + 1, 0) by (i, 0): every pair once
            if j + 1 < width:
                heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))
            cell = first[i] * width + second[j]
            if n := counts[cell]:
                met += n
                found.append(cell)
        return found


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x @ centroids.T - 0.5 * (centroids * centroids).sum(axis=1)).argmax(axis=1)


def _codebook(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """k-means from k different rows; a centroid that loses all rows stays where it is."""
    distinct = np.unique(x, axis=0)
    centroids = distinct[rng.permutation(len(distinct))[:k]]
    for _ in range(rounds):
        of = _nearest(x, centroids)
        sizes = np.bincount(of, minlength=len(centroids))
        sums = np.stack([np.bincount(of, x[:, d], len(centroids)) for d in range(x.shape[1])], axis=1)
        centroids = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centroids)
    return centroids


def fit(sample: np.ndarray, neighbours: int, centroids: int = CENTROIDS, target: float = TARGET) -> Index:
    rng = np.random.default_rng(7)
    half = sample.shape[1] // 2
    k = max(1, min(centroids, len(sample) // 8))
    index = Index(_codebook(sample[:, :half], k, rng), _codebook(sample[:, half:], k, rng), 1.0)
    queries = rng.permutation(len(sample))[:256]
    if len(sample) <= 4 * neighbours:
        return index
    q = sample[queries]
    cells = index.cells(sample)
    near = (q[:, :half] @ index.left.T)[:, cells // len(index.right)] + (q[:, half:] @ index.right.T)[:, cells % len(index.right)]
    exact = q @ sample.T
    exact[np.arange(len(q)), queries] = -np.inf
    top = np.argpartition(-exact, neighbours, axis=1)[:, :neighbours]
    # share of the entries whose cells come no later than a true neighbour's
    before = np.sort(-near, axis=1)
    place = np.stack([np.searchsorted(before[i], -near[i, top[i]], "right") for i in range(len(q))]) / len(sample)
    return Index(index.left, index.right, float(np.quantile(place, target)))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector) of the rows that take part, without repeated rows."""
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.where("vec_id IS NOT NULL AND size(vector) > 0").where(finite & F.exists("vector", lambda v: v != 0))
    sizes = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("vector") == (sizes["n"] if sizes else 0))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def nearest(vectors: DataFrame, is_query, neighbours: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``vectors`` (vec_id, embedding) that satisfy the condition on vec_id."""
    spark = vectors.sparkSession
    rows = checkpointed(usable(vectors))
    picked = rows.orderBy(F.xxhash64("vec_id", F.lit("sample")), "vec_id").limit(SAMPLE_ROWS).toPandas()
    result = "query_id long, vec_id long, score double"
    if picked.empty:
        return spark.createDataFrame([], result).select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    base = fit(_matrix(picked["vector"]), neighbours)

    # equal vectors become one entry with their smallest ids; the limit is applied before the shuffle as well
    copies = Window.partitionBy("vector").orderBy("vec_id")
    few = rows.distinct().withColumn("n", F.row_number().over(copies)).where(F.col("n") <= neighbours + 1)
    entries = few.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))

    def place(frames):
        for frame in frames:
            yield frame.assign(cell=base.cells(_matrix(frame["vector"]))) if len(frame) else frame.assign(cell=0)

    entries = checkpointed(entries.mapInPandas(place, "vector array<double>, ids array<long>, cell long"))
    counts = np.zeros(len(base.left) * len(base.right), np.int64)
    for r in entries.groupBy("cell").count().collect():
        counts[r["cell"]] = r["count"]
    index = Index(base.left, base.right, base.share, counts)

    # cells in order fill shards; a cell larger than a shard takes several of its own
    first = np.zeros(len(counts), np.int64)
    parts = np.maximum(1, -(-counts // SHARD_ROWS))
    shard = filled = 0
    for cell, n in enumerate(counts.tolist()):
        if filled and filled + n > SHARD_ROWS:
            shard, filled = shard + 1, 0
        first[cell] = shard
        if parts[cell] > 1:
            shard, filled = shard + int(parts[cell]), 0
        else:
            filled += n

    def deal(frames):
        for frame in frames:
            cell = frame["cell"].to_numpy()
            spread = np.array([ids[0] for ids in frame["ids"]], np.int64) * 2654435761 % (1 << 31)
            yield frame.assign(shard=first[cell] + spread % parts[cell])

    asked = rows.where(is_query)
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))

    def walks(frames):
        for frame in frames:
            out = []
            for query_id, vector in zip(frame["vec_id"], frame["vector"]):
                by_shard: dict[int, list[int]] = {}
                for cell in index.walk(np.asarray(vector, np.float64)):
                    for s in range(first[cell], first[cell] + parts[cell]):
                        by_shard.setdefault(int(s), []).append(cell)
                out += [(query_id, vector, s, cells) for s, cells in by_shard.items()]
            yield pd.DataFrame(out, columns=["query_id", "vector", "shard", "cells"])

    queries = asked.distinct().repartition(min(blocks * 8, 512), "vec_id").mapInPandas(walks, "query_id long, vector array<double>, shard long, cells array<long>")
    queries = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    dealt = entries.mapInPandas(deal, "vector array<double>, ids array<long>, cell long, shard long")
    dealt = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("block", F.col("block").cast("long"))

    def rank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        right = right.sort_values("cell", kind="stable").reset_index(drop=True)
        x, cells, ids = _matrix(right["vector"]), right["cell"].to_numpy(), right["ids"].tolist()
        edges = {int(c): (a, b) for c, a, b in zip(*_runs(cells))}
        out = []
        for query_id, vector, wanted in zip(left["query_id"], left["vector"], left["cells"]):
            q = np.asarray(vector, np.float64)
            spans = [edges[c] for c in wanted.tolist() if c in edges]
            if not spans:
                continue
            at = np.concatenate([np.arange(a, b) for a, b in spans])
            near = x[at] @ q
            if len(at) > neighbours + 1:
                # all that tie with the last place stay, up to rounding
                least = np.partition(near, len(near) - neighbours - 1)[len(near) - neighbours - 1]
                at = at[near >= least - 1e-9 * max(1.0, abs(least))]
            scores = (x[at] * q).sum(axis=1)
            best = sorted(((-s, i) for s, row in zip(scores.tolist(), at.tolist()) for i in ids[row] if i != query_id))[:neighbours]
            out += [(query_id, i, -s) for s, i in best]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = queries.groupBy("shard", "block").cogroup(dealt.groupBy("shard", "block")).applyInPandas(rank, result)
    # an id that occurs with several vectors counts with its nearest
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= neighbours)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _runs(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate([[True], np.diff(cells) != 0]))
    return cells[starts], starts, np.append(starts[1:], len(cells))
