"""A table with a key, kept in buckets, of which a write reads and replaces only those that it touches.

Rows lie in ``data`` by write and bucket, a hash of the key. ``heads`` says which write holds the current rows of
each bucket, once per write. A reader takes the newest head, so it sees a write as a whole or not at all, and a write that
is repeated starts from the head before it and replaces itself.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WRITE, BUCKET = "write_id", "bucket"
HEAD = f"{BUCKET} int, holder bigint"


@dataclass(frozen=True)
class KeyedTable:
    """``columns`` as DDL, ``keys`` among them. Among rows of a key the last by ``order`` counts, also against stored ones.

    ``update_cols`` are replaced when a key is known, all but the keys by default. ``buckets`` bounds the part that one
    write touches for a few keys; a table's number of buckets never changes.
    """

    spark: SparkSession
    path: str
    columns: str
    keys: tuple[str, ...]
    order: tuple[str, ...]
    update_cols: tuple[str, ...] | None = None
    buckets: int = 64
    schema: T.StructType = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "schema", T.StructType.fromDDL(self.columns))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def heads(self, before: int | None = None) -> dict[int, int]:
        """The write that holds each bucket: as of the newest write, or of the newest one before ``before``."""
        try:
            heads = self.spark.read.schema(f"{HEAD}, {WRITE} bigint").parquet(f"{self.path}/heads")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return {}
        # A row per bucket; only the folder of one write is read.
        known = heads if before is None else heads.where(F.col(WRITE) < before)
        newest = known.agg(F.max(WRITE)).first()[0]
        return {r[0]: r[1] for r in heads.where(F.col(WRITE) == newest).collect()} if newest is not None else {}

    def _rows(self, held: dict[int, int]) -> DataFrame:
        if not held:
            return self.spark.createDataFrame([], self.schema)
        paths = [f"{self.path}/data/{WRITE}={write}/{BUCKET}={bucket}" for bucket, write in sorted(held.items())]
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self) -> DataFrame:
        """The current rows."""
        return self._rows(self.heads())

    def read_before(self, write_id: int, wanted: DataFrame) -> DataFrame:
        """Rows as they were before ``write_id``, from the buckets that hold a key of ``wanted``."""
        held = self.heads(write_id)
        touched = {r[0] for r in wanted.select(self._bucket().alias(BUCKET)).distinct().collect()}
        return self._rows({b: w for b, w in held.items() if b in touched})

    def look_up(self, wanted: DataFrame) -> DataFrame:
        """The current rows whose keys are in ``wanted``; only the files of buckets that hold such a key are read."""
        held = self.heads()
        touched = {r[0] for r in wanted.select(self._bucket().alias(BUCKET)).distinct().collect()}  # a number per bucket
        few = wanted.select(*[F.col(k).alias(f"_w{i}") for i, k in enumerate(self.keys)]).distinct()
        same = [F.col(k).eqNullSafe(F.col(f"_w{i}")) for i, k in enumerate(self.keys)]
        return self._rows({b: w for b, w in held.items() if b in touched}).join(few, same, "left_semi")

    def write(self, updates: DataFrame, write_id: int) -> set[int]:
        """Merge rows by key; returns the buckets that were read and replaced. Writes come in the order of ``write_id``.

        The stored rows meet the new ones in joins that keep them where they are if the new ones are few enough for
        Spark to broadcast them; nothing else of the table is read.
        """
        held = self.heads(write_id)
        latest = self._latest(updates.select(*self.schema.fieldNames())).withColumn(BUCKET, self._bucket())
        latest = latest.persist()
        try:
            touched = {r[0] for r in latest.select(BUCKET).distinct().collect()}  # a number per bucket
            merged = self.merge(self._rows({b: w for b, w in held.items() if b in touched}), latest)
            merged.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/data/{WRITE}={write_id}")
        finally:
            latest.unpersist()
        heads = held | dict.fromkeys(touched, write_id)
        made = self.spark.createDataFrame(sorted(heads.items()), HEAD).coalesce(1)
        made.write.mode("overwrite").parquet(f"{self.path}/heads/{WRITE}={write_id}")
        return touched

    def _latest(self, rows: DataFrame) -> DataFrame:
        """One row per key, with equal orders the largest row; partial results are formed before the shuffle."""
        others = [c for c in self.schema.fieldNames() if c not in self.keys]
        sortable = [c for c in others if c not in self.order and "map<" not in self.schema[c].dataType.simpleString()]
        last = F.max_by(F.struct(*others), F.struct(*self.order, *sortable)).alias("_row")
        return rows.groupBy(*self.keys).agg(last).select(*self.keys, "_row.*").select(*rows.columns)

    def merge(self, old: DataFrame, latest: DataFrame) -> DataFrame:
        """Stored rows, replaced where a newer one has come, and the new keys. ``latest`` has one row per key and its bucket."""
        names = self.schema.fieldNames()
        replaced = set(self.update_cols if self.update_cols is not None else [c for c in names if c not in self.keys])
        new = latest.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)], F.struct(*names).alias("_new"))
        same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(self.keys)]
        joined = old.join(new, same, "left")
        if self.order:
            newer = F.struct(*[f"_new.{c}" for c in self.order]) >= F.struct(*self.order)
        else:
            newer = F.lit(True)
        taken = F.col("_new").isNotNull() & newer
        picked = [F.when(taken, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in replaced else F.col(c) for c in names]
        known = old.join(new, same, "left_semi").select(*self.keys)
        seen = known.select(*[F.col(k).alias(f"_s{i}") for i, k in enumerate(self.keys)])
        absent = latest.join(seen, [F.col(k).eqNullSafe(F.col(f"_s{i}")) for i, k in enumerate(self.keys)], "left_anti")
        # Stored rows stay in the tasks that read them; new keys are few files per bucket.
        return joined.select(*picked).withColumn(BUCKET, self._bucket()).unionByName(absent.repartition(BUCKET))
