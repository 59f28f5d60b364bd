"""Jaccard join of documents on word n-grams by R-trees over count vectors.

The n-grams of a document are hashed into groups; the numbers per group are a point. Two sets share at
most the sum of the smaller numbers per group, so a page of an R-tree that bounds its points from above
also bounds what any of them can share with a query, and pages and points below the threshold are passed
over. Survivors are verified on their sets.

One tree over everything would neither fit nor prune, so documents meet in buckets first. With all n-grams
in one order, two sets that link have one of their first n-grams in common: so many as a set can do without,
and one more. Rare n-grams come first, so a passage that many documents share brings none of them together.
How often an n-gram occurs is taken from a table of fixed size over hashes: any function of the n-gram gives
a valid order. A bucket holds the documents that meet in an n-gram, and each set of documents that meet,
in however many n-grams, has one tree.

Documents with the same set are one node. In the first rounds each node verifies only its most promising
partner of another component, the last round verifies all partners that are left in other components: no
link between components is lost, and groups of near copies aren't expanded into pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.common import map_column, small_batches, store
from riskweave.llm.components import components

GROUPS, LEAF, FANOUT = 256, 32, 16
#: Counters of n-grams by hash, and the parts that they are added up in.
COUNTERS, PARTS = 1 << 20, 64
#: Steps of a weight while a count doubles; a weight is one byte.
STEPS = 6
#: Neighbours in a leaf that a node of a larger bucket is first compared with.
BESIDE = 2
#: Nodes that a task remembers as done.
SEEN = 200_000
#: Nodes of a bucket that one task takes at once; larger buckets are cut into pairs of such chunks.
CHUNK = 20_000
#: Rows of a table of two numbers up to which it is broadcast.
SMALL = 500_000
#: Pairs of queries and points that a search lays out at once.
PAIRS = 1 << 15
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MULTIPLIERS[0]
    x = (x ^ (x >> np.uint64(29))) * _MULTIPLIERS[1]
    return x ^ (x >> np.uint64(32))


def ngrams(text: str, size: int, seed: int = 0) -> np.ndarray:
    """Sorted hashes of the distinct word n-grams; of fewer words, one of them all."""
    words = text.encode().lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return np.zeros(0, np.uint64)
    known = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))
    if len(words) < size:
        return _mixed(np.array([xxhash.xxh64_intdigest(known.tobytes(), seed + len(words))], np.uint64))
    total = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        total = _mixed(total + known[k : len(known) - size + 1 + k]) * _MULTIPLIERS[2]
    return np.unique(_mixed(total))


class Threshold:
    """Two sets link when ``over`` * intersection >= ``part`` * union."""

    def __init__(self, part: int, over: int):
        self.part, self.over = part, over

    def shared(self, sizes: np.ndarray) -> np.ndarray:
        """The least intersection of two sets with this sum of sizes."""
        return -(-self.part * sizes // (self.over + self.part))

    def first(self, grams: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The n-grams that a set begins with, lightest first; two sets that link have one of them in common."""
        spare = len(grams) - -(-self.part * len(grams) // self.over)
        return grams[np.argsort(weight, kind="stable")[: spare + 1]]  # n-grams of one weight stay sorted


def pack(grams: np.ndarray) -> bytes:
    """Numbers per group, in 8 bits; the largest one stands for any number from it on. Long sets get more groups."""
    groups = GROUPS
    while len(grams) > 16 * groups:
        groups *= 4
    counts = np.bincount((grams & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def unpack(row: bytes, groups: int = GROUPS) -> np.ndarray:
    """The numbers, folded to so many groups."""
    counts = np.frombuffer(row, np.uint8).astype(np.int32)
    counts[counts == 255] = 1 << 22  # a bound on sums of all groups must stay one, and fit
    return counts.reshape(-1, groups).sum(axis=0, dtype=np.int64).clip(max=1 << 22).astype(np.int32)


def finer(rows: list[bytes], i: np.ndarray, j: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """The bounds by as many groups as both sets of a pair have."""
    bound = bound.copy()
    for at in range(len(i)):
        one, other = rows[i[at]], rows[j[at]]
        groups = min(len(one), len(other))
        if groups > GROUPS:
            bound[at] = np.minimum(unpack(one, groups), unpack(other, groups)).sum(dtype=np.int64)
    return bound


def bounds(points: np.ndarray, i: np.ndarray, others: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Most that points i and others j share; a bounded number of pairs is laid out at once."""
    parts = [np.zeros(0, np.int64)]
    for at in range(0, len(i), PAIRS):
        parts.append(np.minimum(points[i[at : at + PAIRS]], others[j[at : at + PAIRS]]).sum(axis=1, dtype=np.int64))
    return np.concatenate(parts)


class CountTree:
    """R-tree over count vectors, packed by splitting at the median of the coordinate that varies most."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = np.concatenate(self._pack(points, np.arange(len(points))))
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels, high, small = [], self.points, self.sizes
        width = LEAF
        while True:
            cuts = np.arange(0, len(high), width)
            high, small = np.maximum.reduceat(high, cuts), np.minimum.reduceat(small, cuts)
            self.levels.append((high, small, width))
            if len(high) == 1:
                break
            width = FANOUT

    def _pack(self, points: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
        if len(rows) <= LEAF:
            return [rows]
        column = points[rows][:, points[rows].var(axis=0).argmax()]
        half = LEAF * max(1, round(len(rows) / LEAF / 2))
        rows = rows[np.argsort(column, kind="stable")]
        return self._pack(points, rows[:half]) + self._pack(points, rows[half:])

    def search(self, point: np.ndarray, size: np.ndarray, rule: Threshold) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All (query, point, bound) that may link, for a block of queries."""
        query, page = np.arange(len(point)), np.zeros(len(point), dtype=np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            high, small, width = self.levels[level]
            bound = bounds(point, query, high, page)
            stay = bound >= rule.shared(size[query] + small[page])
            query, page = query[stay], page[stay]
            below = len(self.levels[level - 1][0]) if level else len(self.points)
            query = np.repeat(query, width)
            page = (page[:, None] * width + np.arange(width)).ravel()
            real = page < below
            query, page = query[real], page[real]
        bound = bounds(point, query, self.points, page)
        stay = bound >= rule.shared(size[query] + self.sizes[page])
        return query[stay], self.order[page[stay]], bound[stay]

    def leaf_pairs(self, reach: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of points of one leaf, each once: all, or those fewer than ``reach`` places apart."""
        first, second = [], []
        for shift in range(1, min(reach, LEAF, len(self.order))):
            at = np.arange(len(self.order) - shift)
            at = at[at // LEAF == (at + shift) // LEAF]
            first.append(self.order[at])
            second.append(self.order[at + shift])
        return np.concatenate(first), np.concatenate(second)


def partners(points: np.ndarray, sizes: np.ndarray, group: np.ndarray, rule: Threshold, most: int | None) -> tuple[np.ndarray, ...]:
    """Pairs (i, j, bound) of a bucket's nodes in different groups that may link.

    ``most`` None finds all; else a node gets at most that many, and 0 looks for them beside it in its leaf only.
    A largest group of several nodes does no searching: each pair of different groups has another node.
    """
    tree = CountTree(points, sizes)
    if most == 0 or len(points) <= LEAF:
        i, j = tree.leaf_pairs(LEAF if len(points) <= LEAF else BESIDE + 1)
        apart = group[i] != group[j]
        i, j = i[apart], j[apart]
        bound = bounds(points, i, points, j)
        stay = bound >= rule.shared(sizes[i] + sizes[j])
        return i[stay], j[stay], bound[stay]
    names, at, many = np.unique(group, return_inverse=True, return_counts=True)
    asking = np.flatnonzero(at != many.argmax()) if many.max() > 1 else np.arange(len(points))
    found = [(np.zeros(0, np.int64),) * 3]
    step = max(1, PAIRS // len(points))
    for at in range(0, len(asking), step):
        ask = asking[at : at + step]
        i, j, bound = tree.search(points[ask], sizes[ask], rule)
        i = ask[i]
        stay = group[i] != group[j]
        i, j, bound = i[stay], j[stay], bound[stay]
        if most:
            order = np.lexsort((-bound, i))
            i, j, bound = i[order], j[order], bound[order]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            i, j, bound = i[rank < most], j[rank < most], bound[rank < most]
        found.append((i, j, bound))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _small_buckets(points: np.ndarray, sizes: np.ndarray, group: np.ndarray, bucket: np.ndarray, rule: Threshold) -> tuple[np.ndarray, ...]:
    """The same for many buckets of one leaf each, which lie side by side."""
    found = [(np.zeros(0, np.int64),) * 3]
    for shift in range(1, LEAF):
        at = np.flatnonzero(bucket[shift:] == bucket[:-shift]) if len(bucket) > shift else np.zeros(0, np.int64)
        if not len(at):
            break
        at = at[group[at] != group[at + shift]]
        bound = bounds(points, at, points, at + shift)
        stay = bound >= rule.shared(sizes[at] + sizes[at + shift])
        found.append((at[stay], at[stay] + shift, bound[stay]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _name(grams: np.ndarray, seed: int) -> int:
    return xxhash.xxh64_intdigest(grams.tobytes(), seed) - (1 << 63)


def describe(docs: DataFrame, size: int, seed: int) -> DataFrame:
    """(doc_id, n_shingles, node, proof, counts) per row; node and proof are hashes of the whole set."""

    def rows(texts: pa.Array) -> dict[str, pa.Array]:
        sets = [ngrams(t, size, seed) for t in texts.to_pylist()]
        return {
            "n_shingles": pa.array([len(grams) for grams in sets], pa.int64()),
            "node": pa.array([_name(grams, seed) for grams in sets], pa.int64()),
            "proof": pa.array([_name(grams, seed + 1) for grams in sets], pa.int64()),
            "counts": pa.array([pack(grams) for grams in sets], pa.binary()),
        }

    return map_column(docs, rows, "n_shingles long, node long, proof long, counts binary")


def weights(docs: DataFrame, size: int, seed: int) -> bytes:
    """How often n-grams occur in ``docs``, on a logarithmic scale of a byte for each of the counters."""
    small_batches(docs.sparkSession)
    each = COUNTERS // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            known = [_counter(ngrams(text or "", size, seed)) for text in batch.column("text").to_pylist()]
            if known:
                total += np.bincount(np.concatenate(known), minlength=COUNTERS)
        parts = [k for k in range(PARTS) if total[k * each : (k + 1) * each].any()]
        sums = [total[k * each : (k + 1) * each].tobytes() for k in parts]
        yield pa.RecordBatch.from_pydict({"part": pa.array(parts, pa.int32()), "sums": pa.array(sums, pa.binary())})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, sums in zip(batch.column("part").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                total[part] = total.get(part, 0) + np.frombuffer(sums, np.int64)
        weight = [np.minimum(STEPS * np.log2(1 + x), 255).astype(np.uint8).tobytes() for x in total.values()]
        yield pa.RecordBatch.from_pydict({"part": pa.array(list(total), pa.int32()), "weight": pa.array(weight, pa.binary())})

    parts = docs.select("text").mapInArrow(run, "part int, sums binary")
    weight = np.zeros((PARTS, each), np.uint8)
    for row in parts.repartition("part").mapInArrow(added, "part int, weight binary").collect():  # a megabyte in all
        weight[row.part] = np.frombuffer(row.weight, np.uint8)
    return weight.tobytes()


def _counter(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def first_ngrams(docs: DataFrame, size: int, rule: Threshold, seed: int) -> DataFrame:
    """(gram, node) of the n-grams that each set begins with; a task gives a node's mostly once."""
    weight = docs.sparkSession.sparkContext.broadcast(weights(docs, size, seed))  # COUNTERS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale, seen = np.frombuffer(weight.value, np.uint8), set()
        for batch in batches:
            marks, nodes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for text in batch.column("text").to_pylist():
                grams = ngrams(text or "", size, seed)
                node = _name(grams, seed)
                if not len(grams) or node in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(node)
                marks.append(rule.first(grams, scale[_counter(grams)]))
                nodes.append(np.full(len(marks[-1]), node))
            yield pa.RecordBatch.from_pydict({"gram": pa.array(np.concatenate(marks).view(np.int64)), "node": pa.array(np.concatenate(nodes))})

    return docs.select("text").mapInArrow(run, "gram long, node long")


def meetings(docs: DataFrame, size: int, rule: Threshold, seed: int) -> DataFrame:
    """(signature, node, many): each set of nodes that meet in an n-gram, once.

    Sets with one signature would be one bucket, which loses no pair.
    """
    met = store(first_ngrams(docs, size, rule, seed).distinct(), "met")
    # Summed before they move: an n-gram that very many sets begin with is one small row, and its nodes can be split in the join.
    known = met.groupBy("gram").agg(
        F.count(F.lit(1)).alias("many"), F.min("node").alias("low"), F.max("node").alias("high"), F.bit_xor(F.xxhash64("node")).alias("all")
    )
    known = known.where(F.col("many") > 1).select("gram", F.xxhash64("many", "low", "high", "all").alias("signature"), "many")
    return met.join(known, "gram").select("signature", "node", "many").distinct()


def candidates(buckets: DataFrame, rule: Threshold, most: int | None) -> DataFrame:
    """(a, b, bound) of the nodes of (signature, many, node, n_shingles, counts, component) that their bucket's tree brings together."""
    chunks = F.ceil(F.col("many") / CHUNK).cast("int")
    own = F.pmod(F.xxhash64("node"), chunks).cast("int")
    others = F.transform(F.sequence(F.lit(0), chunks - 1), lambda c: F.struct(F.least(c, own).alias("x"), F.greatest(c, own).alias("y")))
    keyed = buckets.withColumn("_pair", F.explode(others)).select(
        F.xxhash64("signature", "_pair.x", "_pair.y").alias("bucket"), "node", "n_shingles", "counts", "component"
    )
    dealt = keyed.repartition("bucket").sortWithinPartitions("bucket", "node")

    def made(rows: pa.Table) -> pa.RecordBatch:
        bucket = rows.column("bucket").to_numpy()
        node, sizes, group = (rows.column(c).to_numpy() for c in ("node", "n_shingles", "component"))
        packed = rows.column("counts").to_pylist()
        points = np.stack([unpack(row) for row in packed])
        starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
        many = np.repeat(np.diff(starts), np.diff(starts))
        small = np.flatnonzero(many <= LEAF)
        i, j, bound = _small_buckets(points[small], sizes[small], group[small], bucket[small], rule)
        found = [(small[i], small[j], bound)]
        for low, high in zip(starts[:-1], starts[1:], strict=True):
            if high - low > LEAF:
                i, j, bound = partners(points[low:high], sizes[low:high], group[low:high], rule, most)
                found.append((i + low, j + low, bound))
        i, j, bound = (np.concatenate(x) for x in zip(*found, strict=True))
        bound = finer(packed, i, j, bound)
        stay = bound >= rule.shared(sizes[i] + sizes[j])
        i, j, bound = i[stay], j[stay], bound[stay]
        a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
        return pa.RecordBatch.from_pydict({"a": pa.array(a), "b": pa.array(b), "bound": pa.array(bound.astype(np.int64))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            mark = batch.column("bucket").to_numpy()
            last = int(np.searchsorted(mark, mark[-1]))  # sorted: the last bucket may go on
            if last or (held and held[-1].column("bucket")[-1].as_py() != mark[0]):
                whole = [*held, batch.slice(0, last)] if last else held
                yield made(pa.Table.from_batches(whole))
                held = []
            held.append(batch.slice(last))
        if held:
            yield made(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, "a long, b long, bound long").distinct()


def verified(pairs: DataFrame, sets: DataFrame, rule: Threshold) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    left = sets.select(F.col("node").alias("a"), F.col("grams").alias("one"))
    right = sets.select(F.col("node").alias("b"), F.col("grams").alias("other"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, other in zip(batch.column("one").to_pylist(), batch.column("other").to_pylist(), strict=True):
                x, y = np.frombuffer(one, np.uint64), np.frombuffer(other, np.uint64)
                keep.append(len(np.intersect1d(x, y, assume_unique=True)) >= int(rule.shared(np.int64(len(x) + len(y)))))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, size: int, seed: int) -> DataFrame:
    """(node, grams) of the nodes in ``pairs``, from the texts."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = nodes.join(ends, "node", "left_semi").select("node", F.col("first").alias("doc_id"))
    wanted = store(wanted.where(F.col("doc_id").isNotNull()), "wanted")
    if wanted.count() <= SMALL:  # 16 bytes a row; else the texts are shuffled
        wanted = F.broadcast(wanted)
    texts = docs.select("doc_id", "text").join(wanted, "doc_id")

    def rows(column: pa.Array) -> dict[str, pa.Array]:
        grams = [ngrams(t, size, seed).tobytes() for t in column.to_pylist()]
        return {"grams": pa.array(grams, pa.binary()), "found": pa.array([_name(np.frombuffer(g, np.uint64), seed) for g in grams], pa.int64())}

    made = map_column(texts, rows, "grams binary, found long", keep=("node",))
    # An id that several texts have brings them all; the node tells which one is meant.
    return made.where(F.col("node") == F.col("found")).dropDuplicates(["node"]).select("node", "grams")


def jaccard_components(docs: DataFrame, size: int = 3, part: int = 90, over: int = 100) -> DataFrame:
    """Components of documents whose n-gram sets have a Jaccard similarity of ``part`` / ``over`` or more.

    (doc_id, n_shingles, component_id) per row of ``docs``. Words lie between ASCII white space, with A-Z
    lower-cased; fewer than ``size`` words are one n-gram. A text without words, or null, has no n-gram and
    links with nothing. ``component_id`` is the smallest doc_id that links reach. A set that only rows with a
    null id hold takes no part in links, and their component is null.
    """
    rule, seed = Threshold(part, over), 0
    while True:
        rows = store(describe(docs, size, seed), "described")
        nodes = store(
            rows.where(F.col("n_shingles") > 0)
            .groupBy("node")
            .agg(F.min("doc_id").alias("first"), F.min("proof").alias("low"), F.max("proof").alias("high"), F.first("n_shingles").alias("n_shingles"), F.first("counts").alias("counts")),
            "nodes",
        )
        if nodes.where(F.col("low") != F.col("high")).isEmpty():
            break
        seed += 2  # two sets had one hash: take another
    same = Window.partitionBy("signature")
    buckets = store(meetings(docs, size, rule, seed), "buckets")
    points = nodes.select("node", "n_shingles", "counts")
    labels = nodes.select("node", F.col("node").alias("component"))
    links = tried = leaves = None
    for most in (0, 4, None):
        if leaves is None:  # pairs of one leaf: all that smaller buckets have
            known = buckets.join(points.withColumn("component", F.col("node")), "node")
            pairs = leaves = store(candidates(known, rule, most), "candidates")
        else:
            known = buckets.where(F.col("many") > LEAF).join(labels, "node")
            known = known.withColumns({"_low": F.min("component").over(same), "_high": F.max("component").over(same)})
            known = known.where(F.col("_low") != F.col("_high")).drop("_low", "_high").join(points, "node")
            pairs = candidates(known, rule, most).union(leaves).distinct().join(tried, ["a", "b"], "left_anti")
            ends = [labels.select(F.col("node").alias(c), F.col("component").alias(f"_{c}")) for c in ("a", "b")]
            pairs = pairs.join(ends[0], "a").join(ends[1], "b").where(F.col("_a") != F.col("_b"))
        if most is not None:  # each node's most promising partner
            sides = [F.struct(F.col(c).alias("node"), F.struct("bound", "a", "b").alias("pair")) for c in ("a", "b")]
            ranked = pairs.select(F.inline(F.array(*sides)))
            pairs = ranked.groupBy("node").agg(F.max("pair").alias("best")).select("best.a", "best.b").distinct()
        pairs = store(pairs.select("a", "b"), "pairs")
        tried = pairs if tried is None else tried.union(pairs)
        if pairs.isEmpty():
            continue
        sets = store(_sets(docs, pairs, nodes, size, seed), "sets")
        new = store(verified(pairs, sets, rule), "verified")
        links = new if links is None else links.union(new)
        found = components(links)
        labels = store(
            nodes.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component")), "labels"
        )
    least = nodes.select("node", "first").join(labels, "node")
    smallest = least.groupBy("component").agg(F.min("first").alias("component_id"))
    named = least.join(smallest, "component").select("node", "component_id")
    joined = rows.select("doc_id", "n_shingles", "node").join(named, "node", "left")
    return joined.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, size: int = 5, part: int = 80, over: int = 100) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component, with all columns; rows with a null id stay."""
    found = jaccard_components(docs, size, part, over)
    kept = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").unionByName(docs.where(F.col("doc_id").isNull())).select(*docs.columns)
