"""Table scans and stored tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.schemas import STORED_DECIMALS


def read_table(spark: SparkSession, name: str, location: str | Mapping[str, str] | None = None) -> DataFrame:
    """A table by name from a parquet folder, from a database, or from the catalog.

    ``location`` is the folder that holds ``<name>`` or ``<name>.parquet``, or the JDBC options ``url`` etc.
    (give ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions`` for a parallel scan).
    """
    if location is None:
        return spark.table(name)
    if isinstance(location, str):
        try:
            return spark.read.parquet(f"{location.rstrip('/')}/{name}")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.read.parquet(f"{location.rstrip('/')}/{name}.parquet")
    return spark.read.format("jdbc").options(**location).option("dbtable", name).load()


def to_stored(df: DataFrame) -> DataFrame:
    """Money columns as decimals, epoch-millisecond columns also as timestamps: the form tables are kept in."""
    casts = {c: F.col(c).try_cast(t) for c, t in STORED_DECIMALS.items() if c in df.columns}
    stamps = {
        c.removesuffix("_ms"): F.timestamp_millis(F.col(c))
        for c in df.columns
        if c.endswith("_ms") and isinstance(df.schema[c].dataType, T.LongType)
    }
    return df.withColumns(casts | stamps) if casts or stamps else df
