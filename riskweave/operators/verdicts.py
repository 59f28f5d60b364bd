"""Verdict records as they arrive: parse, check, split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.functions.json import parse_all, readable
from riskweave.schemas import CLASSIFICATIONS

# Required fields of a verdict (fixed values).
REQUIRED = ("is_fraud", "confidence", "ai_risk_score", "classification", "reasoning", "recommended_actions")

_RAW = T.StructType([T.StructField(name, T.StringType()) for name in REQUIRED])


def validate_verdicts(raw: DataFrame, value_col: str = "value") -> tuple[DataFrame, DataFrame]:
    """Split raw JSON verdicts into (accepted typed rows, rejected rows with ``reason``)."""
    carried = [c for c in raw.columns if c != value_col]
    typed = parse_all(raw, value_col, _RAW, "_v").select(
        *carried,
        F.col(value_col).alias("_raw"),
        readable("_v").alias("_readable"),
        *[F.col(f"_v.{name}").alias(f"_{name}") for name in REQUIRED],
        F.col("_v.is_fraud").try_cast("boolean").alias("is_fraud"),
        F.col("_v.confidence").try_cast("double").alias("confidence"),
        F.col("_v.ai_risk_score").try_cast("int").alias("ai_risk_score"),
        F.col("_v.classification").alias("classification"),
        F.col("_v.reasoning").alias("reasoning"),
        F.from_json("_v.recommended_actions", "array<string>").alias("recommended_actions"),
    )
    reason = F.when(~F.col("_readable"), F.lit("not readable"))
    for name in REQUIRED:
        reason = reason.when(F.col(f"_{name}").isNull(), F.lit(f"{name} missing"))
    for name in ("is_fraud", "confidence", "ai_risk_score", "recommended_actions"):
        reason = reason.when(F.col(name).isNull(), F.lit(f"{name} has the wrong type"))
    reason = (
        reason.when(~F.col("confidence").between(0.0, 1.0), F.lit("confidence out of range"))
        .when(~F.col("ai_risk_score").between(0, 100), F.lit("ai_risk_score out of range"))
        .when(~F.col("classification").isin(*CLASSIFICATIONS), F.lit("classification unknown"))
    )
    checked = typed.withColumn("reason", reason)
    accepted = checked.where(F.col("reason").isNull()).select(*carried, *REQUIRED)
    rejected = checked.where(F.col("reason").isNotNull()).select(*carried, F.col("_raw").alias(value_col), "reason")
    return accepted, rejected
