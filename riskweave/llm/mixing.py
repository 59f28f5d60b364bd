"""Mixing sources to target weights by pivotal rounding.

Every document of a source shall be taken the same number of times on average: its source's target over
its source's size. The whole part is certain; the fraction is rounded by the pivotal method: of two
documents with fractions, one hands words to the other, in a random direction that is fair to both, until
one of them is decided. Words are kept: what one gives, the other gets, so the source's words stay at
their target up to the last undecided document. Documents are paired within blocks, the one that is left
of each block goes up to a block of the next level, and so on: a tree of blocks of bounded size.

A document that holds much of its source is too long for the others to make up for one at a time. So
the few longest are decided first, and what they take too much or too little changes the fraction of all
shorter ones together. Long documents also come first in each block, so the last undecided one is short.

Rows that agree in source, id and size are one document that is taken up to that many times as often; what it gets is
shared out evenly among them.

Only DataFrame functions are used, and all draws are hashes, so a rerun takes the same documents.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.common import WORD, store

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
#: Documents that meet in one block on average.
BLOCK = 100
#: Equal rows that are written as one at first.
ALIKE = 10_000
#: Documents that hold one part in so many of their source, or more, are decided before shorter ones; they are as many at most.
LAYERS = (10, 100, 1000)


def word_count(text: Column) -> Column:
    """Number of words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """(source, documents, source_size, target) per source of (doc_id, source, size) rows.

    The sources, by code point with null last, take ``weights`` in turn and share ``share`` of all words. A
    target stops at ``most`` times its source's size; the excess goes to the others by weight. Windows run
    over one row per source.
    """
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    # Sources reach their caps in the order of cap over weight: all before the level stop there, the rest is shared.
    every = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    after = every.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    wanted = F.sum("source_size").over(whole) * share
    level = (wanted - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    per = per.withColumn("level", level)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level")))
    per = per.withColumn("level", F.min(fits).over(whole)["level"])
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return per.select("source", "documents", "source_size", target.alias("target"))


def _draw(*parts: Column) -> Column:
    """A number in [0, 1) that depends on ``parts`` alone."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / float(1 << 53)


def _meet(state: Column, other: Column, seed: int) -> Column:
    """The undecided document of ``state`` and ``other`` exchange words until one of them is decided."""
    one = state["left"]
    gives, lacks = one["p"] * one["size"], (1 - one["p"]) * one["size"]
    other_gives, other_lacks = other["p"] * other["size"], (1 - other["p"]) * other["size"]
    rise, fall = F.least(lacks, other_gives), F.least(gives, other_lacks)
    up = _draw(F.lit(seed), one["doc_id"], other["doc_id"], one["size"], other["size"]) * (rise + fall) < fall
    facts = F.struct(
        one.alias("one"),
        other.alias("other"),
        up.alias("up"),
        F.when(up, rise).otherwise(-fall).alias("words"),
        F.when(up, lacks <= other_gives).otherwise(gives <= other_lacks).alias("first"),
    )

    def settle(t: Column) -> Column:
        moved = lambda d, sign: F.least(F.lit(1.0), F.greatest(F.lit(0.0), d["p"] + sign * t["words"] / d["size"]))
        left = lambda d, p: F.struct(d["doc_id"].alias("doc_id"), d["size"].alias("size"), d["many"].alias("many"), d["whole"].alias("whole"), p.alias("p"))
        done = lambda d, up: F.struct(d["doc_id"].alias("doc_id"), d["size"].alias("size"), d["many"].alias("many"), (d["whole"] + up.cast("long")).alias("copies"))
        return F.struct(
            F.when(t["first"], left(t["other"], moved(t["other"], -1))).otherwise(left(t["one"], moved(t["one"], 1))).alias("left"),
            F.concat(
                state["done"], F.array(F.when(t["first"], done(t["one"], t["up"])).otherwise(done(t["other"], ~t["up"])))
            ).alias("done"),
        )

    return F.transform(F.array(facts), settle)[0]


def _round_blocks(items: DataFrame, seed: int) -> DataFrame:
    """One row per block: its decided documents, and the one that is left."""
    keys = ["source", "source_size", "target", "block"]
    met = items.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("order", "item"))).alias("items"))
    met = met.withColumn("items", F.transform("items", lambda x: x["item"]))
    none = F.expr("cast(array() as array<struct<doc_id: {0}, size: bigint, many: bigint, copies: bigint>>)".format(_id_type(items)))
    start = F.struct(F.col("items")[0].alias("left"), none.alias("done"))
    rest = F.slice("items", F.lit(2), F.size("items"))
    state = F.aggregate(rest, start, lambda s, x: _meet(s, x, seed))
    return met.select(*keys, state.alias("state")).select(*keys, "state.left", "state.done")


def _id_type(items: DataFrame) -> str:
    return items.select("item.doc_id").schema["doc_id"].dataType.simpleString()


def _by_source(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """Add the columns of a table of sources; null is a source."""
    named = per_source.withColumnRenamed("source", "_source")
    return rows.join(named, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")


def _items(rows: DataFrame, shares: DataFrame, block: Column, order: Column) -> DataFrame:
    """The rows as members of blocks, each with its source's fraction; of the fractions of equal rows, what is left of whole ones."""
    item = F.struct("doc_id", "size", "many", (F.col("many") * F.col("whole") + F.floor("_p")).cast("long").alias("whole"), (F.col("_p") - F.floor("_p")).alias("p"))
    placed = _by_source(rows.drop("p"), shares.select("source", "p")).withColumn("_p", F.col("many") * F.col("p"))
    return placed.select(
        "source", "source_size", "target", block.alias("block"), F.struct(-F.col("size"), order).alias("order"), item.alias("item")
    )


def _decided(done: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The documents that their blocks have decided."""
    one = done.select("source", "source_size", "target", F.explode("done").alias("d"))
    return one.select("source", "source_size", "target", "d.*").select(*columns)


def _drawn(done: DataFrame, seed: int, columns: tuple[str, ...]) -> DataFrame:
    """The documents that are left, decided by a draw."""
    last = _draw(F.lit(seed), F.col("left.doc_id"), F.col("left.size")) < F.col("left.p")
    copies = F.col("left.whole") + last.cast("long")
    return done.select("source", "source_size", "target", "left.doc_id", "left.size", "left.many", copies.alias("copies")).select(*columns)


def mix(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 0, block: int = BLOCK
) -> DataFrame:
    """How often each document is taken: (doc_id, source, size, source_size, target, copies, taken).

    One row per row of ``docs``. A null text has size 0; empty documents are taken as often as the whole part
    says, which takes no words. A null source is a source of its own.
    """
    found = mix_alike(docs, weights, share, most, seed, block)
    parts = F.sequence(F.lit(0), F.floor((F.col("many") - 1) / ALIKE))
    parted = found.withColumn("_part", F.explode(parts)).repartition("doc_id", "size", "_part")
    first = F.col("_part") * ALIKE
    turns = F.sequence(first, F.least(first + ALIKE, F.col("many")) - 1)
    rows = parted.withColumn("_turn", F.explode(turns)).withColumn("copies", _shared(F.col("copies"), F.col("many"), F.col("_turn")))
    return rows.drop("many", "_part", "_turn").withColumn("taken", F.col("copies") * F.col("size"))


def _shared(copies: Column, many: Column, turn: Column) -> Column:
    """What the row numbered ``turn`` of ``many`` equal ones gets of their copies."""
    return F.floor(copies / many) + (turn < copies % many).cast("long")


def mix_alike(docs: DataFrame, weights: tuple[float, ...], share: float, most: float, seed: int, block: int) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, many): one row for each ``many`` equal rows, with the copies of all."""
    alike = docs.select("doc_id", "source", word_count(F.col("text")).alias("size")).groupBy("doc_id", "source", "size")
    sizes = store(alike.agg(F.count(F.lit(1)).alias("many")), "sizes")
    targets = store(source_targets(sizes.withColumn("size", F.col("size") * F.col("many")), weights, share, most), "targets")
    largest = targets.agg(F.max("documents")).first()[0] or 0
    rows = _by_source(sizes, targets)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("whole", F.floor(ratio + 1e-12)).withColumn("p", F.greatest(ratio - F.floor(ratio + 1e-12), F.lit(0.0)))
    open_ = (F.col("size") > 0) & (F.col("p") > 1e-12)
    columns = ("doc_id", "source", "size", "many", "source_size", "target", "copies")
    parts = [rows.where(~open_).withColumn("copies", F.col("whole") * F.col("many")).select(*columns)]
    blocks = F.ceil(F.col("documents") / block)
    order = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"))
    layer = reduce(lambda other, k: F.when(F.col("size") * LAYERS[k] >= F.col("source_size"), k).otherwise(other), range(len(LAYERS) - 1, -1, -1), F.lit(len(LAYERS)))
    rows = rows.where(open_).withColumn("layer", layer)
    # The fraction is one number per source and layer: what is left of it when the longer documents are decided.
    words = [F.sum(F.when(F.col("layer") > k, F.col("size") * F.col("many")).otherwise(0)).alias(f"rest{k}") for k in range(len(LAYERS))]
    shares = store(rows.groupBy("source").agg(F.max("p").alias("p"), *words), "shares")
    for k in range(len(LAYERS)):
        items = _items(rows.where(F.col("layer") == k), shares, F.lit(0), order)
        done = store(_round_blocks(items, seed - k - 1), "longest")
        decided = _decided(done, columns).unionByName(_drawn(done, seed, columns))
        parts.append(decided)
        got = decided.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("got"), F.sum(F.col("size") * F.col("many")).alias("words"), F.max(F.floor(F.col("target") / F.col("source_size") + 1e-12)).alias("whole"))
        over = F.coalesce(F.col("got") - (F.col("whole") + F.col("p")) * F.col("words"), F.lit(0.0))
        rest = F.when(F.col(f"rest{k}") > 0, over / F.col(f"rest{k}")).otherwise(0.0)
        shares = _by_source(shares, got).withColumn("p", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("p") - rest)))
        shares = store(shares.drop("got", "words", "whole"), "shares")
    items = _items(rows.where(F.col("layer") == len(LAYERS)), shares, F.pmod(order, blocks), order)
    level, count = 0, math.ceil(largest / block)
    while True:
        done = store(_round_blocks(items, seed + level), "blocks")
        parts.append(_decided(done, columns))
        if count <= 1:
            break
        items = done.select(
            "source",
            "source_size",
            "target",
            F.floor(F.col("block") / block).alias("block"),
            F.struct(-F.col("left.size"), F.col("block")).alias("order"),
            F.col("left").alias("item"),
        )
        level, count = level + 1, math.ceil(count / block)
    parts.append(_drawn(done, seed, columns))
    every = reduce(DataFrame.unionByName, parts)
    return every.withColumn("source_size", F.col("source_size").cast("long"))


def take(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 0, block: int = BLOCK
) -> DataFrame:
    """The rows of ``docs``, each as often as :func:`mix` takes it, with all their columns.

    Rows are told apart by a hash of all columns; of rows that repeat them all, one comes as often as all are
    taken together.
    """
    hashed = [F.to_json(F.struct(f.name)) if "map<" in f.dataType.simpleString() else F.col(f.name) for f in docs.schema]
    # Null columns leave the hash as it is, so which ones they are is part of it.
    key = F.xxhash64(*hashed, *[F.col(f.name).isNull() for f in docs.schema])
    named = docs.select(key.alias("doc_id"), "source", "text")
    taken = mix_alike(named, weights, share, most, seed, block).where(F.col("copies") > 0)
    taken = store(taken.select(F.col("doc_id").alias("_taken_key"), F.col("copies").alias("_taken_copies"), F.col("many").alias("_taken_many")), "taken")
    single, repeated = taken.where(F.col("_taken_many") == 1), taken.where(F.col("_taken_many") > 1)
    keyed = docs.withColumn("_taken_key", key)
    joined = keyed.join(single.drop("_taken_many"), "_taken_key")
    found = joined.withColumn("_taken_turn", F.explode(F.sequence(F.lit(1), F.col("_taken_copies")))).select(*docs.columns)
    if repeated.isEmpty():
        return found
    one = keyed.join(repeated, "_taken_key").dropDuplicates(["_taken_key"])
    parted = one.withColumn("_taken_part", F.explode(F.sequence(F.lit(0), F.floor((F.col("_taken_copies") - 1) / ALIKE))))
    here = F.least(F.lit(ALIKE), F.col("_taken_copies") - F.col("_taken_part") * ALIKE)
    parted = parted.repartition("_taken_key", "_taken_part").withColumn("_taken_turn", F.explode(F.sequence(F.lit(1), here.cast("long"))))
    return found.unionByName(parted.select(*docs.columns))
