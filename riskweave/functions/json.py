"""JSON text to columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROKEN = "_broken"


def parse_once(df: DataFrame, value_col: str, schema: T.StructType, name: str) -> DataFrame:
    """Add the JSON text in ``value_col`` as struct ``name``; rows whose text is unreadable are left out.

    The struct comes out of a generator: filters on its fields would otherwise be moved below the
    projection, together with a parse of their own for each.
    """
    return parse_all(df, value_col, schema, name).where(readable(name))


def parse_all(df: DataFrame, value_col: str, schema: T.StructType, name: str) -> DataFrame:
    """The same with the unreadable rows; ``readable`` tells them apart."""
    full = T.StructType([*schema.fields, T.StructField(BROKEN, T.StringType())])
    parsed = F.from_json(value_col, full, {"columnNameOfCorruptRecord": BROKEN})
    return df.select("*", F.explode(F.array(parsed)).alias(name))


def readable(name: str) -> Column:
    return F.col(name).isNotNull() & F.col(f"{name}.{BROKEN}").isNull()
