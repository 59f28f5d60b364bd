"""Nearest neighbours by inner product from vantage-point trees, one per shard.

The largest inner product is the least distance once every vector gets one more coordinate that brings all
to the same length. A tree splits its vectors by their distance to a vantage point; by the triangle
inequality a page can be passed over when its distances from the vantage points on its path are further
from the query's than the query's k-th best. ``factor`` tightens that test: 1, the default, is exact; more
passes over pages that would have to be looked at, most of them where lengths vary or dimensions are few.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.common import small_batches, store

#: Vectors of a shard and queries of a block, on average, and vectors of a page.
SHARD, BLOCK, PAGE = 20_000, 2_000, 512
QUERY_STEP, NEAREST, FACTOR = 20, 20, 1.0
#: Pairs of query and vector that are scored or held at a time.
_PAIRS = 1 << 17


class VantageTree:
    """Pages of vectors, and for each page and vantage point on its path the range of their distances."""

    def __init__(self, vectors: np.ndarray, page: int = PAGE):
        longest = (vectors**2).sum(axis=1)
        self.top = longest.max(initial=0.0)
        self.lifted = np.column_stack([vectors, np.sqrt(np.maximum(self.top - longest, 0.0))])
        self.points: list[int] = []
        self.pages: list[np.ndarray] = []
        self.paths: list[list[tuple[int, float, float]]] = []
        todo = [(np.arange(len(vectors)), [])]
        while todo:
            rows, path = todo.pop()
            if len(rows) <= page:
                self.pages.append(rows)
                self.paths.append(path)
                continue
            # A vector far from the middle sees the others at distances that differ.
            middle = self.lifted[rows].mean(axis=0)
            vantage = rows[((self.lifted[rows] - middle) ** 2).sum(axis=1).argmax()]
            away = np.sqrt(((self.lifted[rows] - self.lifted[vantage]) ** 2).sum(axis=1))
            order = np.argsort(away, kind="stable")
            half = len(rows) // 2
            at = len(self.points)
            self.points.append(vantage)
            for part in (order[:half], order[half:]):
                todo.append((rows[part], [*path, (at, away[part[0]], away[part[-1]])]))

    def _least(self, lifted: np.ndarray, length: np.ndarray) -> np.ndarray:
        """A lower bound of the distance of each query (row) from each page (column)."""
        least = np.zeros((len(lifted), len(self.pages)))
        if self.points:
            square = (lifted**2).sum(axis=1)[:, None] + (self.lifted[self.points] ** 2).sum(axis=1) - 2 * lifted @ self.lifted[self.points].T
            away = np.sqrt(np.maximum(square, 0.0))
            for p, path in enumerate(self.paths):
                for at, low, high in path:
                    least[:, p] = np.maximum(least[:, p], np.maximum(low - away[:, at], away[:, at] - high))
        # Rounding may make a bound a little too large.
        return np.maximum(least - 1e-9 * (1 + length[:, None]), 0.0)

    def search(self, queries: np.ndarray, names: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, row and inner product of the best ``k`` rows per query, equal products by ascending ``names``.

        A first pass over the pages finds the k-th best product. A second one takes every row that reaches it, so that
        of rows that tie, however many, the right ones stay.
        """
        length = np.sqrt((queries**2).sum(axis=1) + self.top)
        least = self._least(np.column_stack([queries, np.zeros(len(queries))]), length)
        order = np.argsort(least, axis=1, kind="stable")
        best = np.full((len(queries), k), -np.inf)
        vectors = self.lifted[:, :-1]
        alive = np.arange(len(queries))
        far = lambda who: np.sqrt(np.maximum(length[who] ** 2 - 2 * np.where(np.isfinite(best[who, -1]), best[who, -1], 0.0), 0.0))
        for turn in range(len(self.pages)):
            page = order[alive, turn]
            stay = ~np.isfinite(best[alive, -1]) | (least[alive, page] * factor <= far(alive))
            alive, page = alive[stay], page[stay]
            if not len(alive):
                break
            for p in np.unique(page):
                who = alive[page == p]
                every = np.hstack([best[who], queries[who] @ vectors[self.pages[p]].T])
                best[who] = -np.sort(np.partition(-every, k - 1, axis=1)[:, :k], axis=1)
        # A product may differ in its last digits from pass to pass.
        floor = best[:, -1] - 1e-9 * (1 + length * np.sqrt(self.top))
        reach = np.where(np.isfinite(best[:, -1]), far(np.arange(len(queries))) * (1 + 1e-9) + 1e-9, np.inf)
        none = np.zeros(0, np.int64)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(none, none, np.zeros(0))]
        size = 0
        for p, there in enumerate(self.pages):
            who = np.flatnonzero(least[:, p] * factor <= reach)
            q, r = np.nonzero(queries[who] @ vectors[there].T >= floor[who, None])
            q, r = who[q], there[r]
            # The same way for every pair, so that ties are ties; a bounded number at a time.
            scores = np.concatenate([np.zeros(0), *((vectors[r[a : a + _PAIRS]] * queries[q[a : a + _PAIRS]]).sum(axis=1) for a in range(0, len(q), _PAIRS))])
            held.append((q, r, scores))
            size += len(q)
            if size > _PAIRS:
                held = [_first(*(np.concatenate(x) for x in zip(*held, strict=True)), names, k)]
                size = 0
        return _first(*(np.concatenate(x) for x in zip(*held, strict=True)), names, k)


def _first(query: np.ndarray, row: np.ndarray, score: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``k`` rows of each query by score, then name."""
    order = np.lexsort((names[row], -score, query))
    query, row, score = query[order], row[order], score[order]
    begin = np.concatenate(([True], query[1:] != query[:-1])) if len(query) else np.zeros(0, bool)
    place = np.arange(len(query)) - np.flatnonzero(begin)[np.cumsum(begin) - 1] if len(query) else query
    return query[place < k], row[place < k], score[place < k]


def _usable(embeddings: DataFrame) -> DataFrame:
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    return rows.where(whole & F.exists("embedding", lambda x: x != 0)).select(
        "vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.size("embedding").alias("width")
    )


def nearest(
    embeddings: DataFrame, k: int = NEAREST, step: int = QUERY_STEP, factor: float = FACTOR, shard: int = SHARD, block: int = BLOCK
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest rows of every row whose id ``step`` divides.

    Nearness is the inner product in double precision; ties go to the smaller vec_id. Rows that are null,
    zero, or hold null or non-finite components take no part, and vectors of other lengths aren't compared.
    A query's own id is no candidate; an id that repeats is one query, of its least vector, and all its
    rows are candidates of others. Every pair of shard and block of queries is one task.
    """
    small_batches(embeddings.sparkSession)
    rows = store(_usable(embeddings), "vectors")
    queries = rows.where(F.col("vec_id") % step == 0).groupBy("width", "vec_id").agg(F.min("embedding").alias("embedding"))
    total, asked = rows.count(), queries.count()
    shards, blocks = max(1, -(-total // shard)), max(1, -(-asked // block))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = F.xxhash64("vec_id", "embedding")  # copies of one id are dealt out too
    held = rows.withColumn("shard", F.pmod(place, F.lit(shards)).cast("int")).withColumn("block", each(blocks))
    asking = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("shard", each(shards))
    schema = "query_id long, vec_id long, score double"

    def run(index: pa.Table, asked: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not index.num_rows or not asked.num_rows:
            return empty
        vectors, ids = _matrix(index)
        points, names = _matrix(asked)
        # Equal vectors are one point of the tree; their rows are kept, smallest id first.
        order = np.lexsort((ids, *vectors.T[::-1]))
        vectors, ids = vectors[order], ids[order]
        new = np.concatenate(([True], (vectors[1:] != vectors[:-1]).any(axis=1)))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(ids))
        tree = VantageTree(vectors[first])
        # A row among the best is of one of the first k + 1 points: at most one of those before it has the query's own row only.
        asking_, reached, scores = tree.search(points, ids[first], k + 1, factor)
        out: list[tuple[int, int, float]] = []
        borders = np.searchsorted(asking_, np.arange(len(points) + 1))
        for q, (a, b) in enumerate(zip(borders[:-1], borders[1:], strict=True)):
            held: list[tuple[float, int]] = []
            for point, score in zip(reached[a:b], scores[a:b], strict=True):
                own = ids[first[point] : last[point]]
                low, high = np.searchsorted(own, (names[q], names[q] + 1))
                held.extend((-score, int(i)) for i in own[: min(low, k)])
                held.extend((-score, int(i)) for i in own[high : high + k])
            out.extend((int(names[q]), i, -s) for s, i in sorted(held)[:k])
        if not out:
            return empty
        a, b, c = zip(*out, strict=True)
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

    keys = ["width", "shard", "block"]
    found = held.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInArrow(run, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _matrix(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Vectors, one per row, and their ids."""
    column = rows.column("embedding").combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(rows.num_rows, -1), rows.column("vec_id").to_numpy()
