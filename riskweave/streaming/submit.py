"""Start one stream job from the command line.

``spark-submit riskweave/streaming/submit.py score --source kafka.bootstrap.servers=host:9092 --checkpoint DIR ...``
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from riskweave.params import RuleParams
from riskweave.session import apply_settings
from riskweave.sources.profiles import read_accounts, read_merchants
from riskweave.streaming.jobs import JobConfig, start_anomaly_job, start_score_job, start_spend_job

JOBS = ("score", "spend", "anomalies")


def pairs(entries: list[str] | None) -> dict[str, str] | None:
    """``key=value`` arguments."""
    return dict(entry.split("=", 1) for entry in entries) if entries else None


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("job", choices=JOBS)
    parser.add_argument("--source", action="append", required=True, help="option of the source, key=value")
    parser.add_argument("--profiles", action="append", help="options of the profile topics, the source's by default")
    parser.add_argument("--sink", action="append", help="option of the publishing sink, key=value")
    parser.add_argument("--checkpoint", required=True)
    parser.add_argument("--table", help="folder of the result table")
    parser.add_argument("--interval", default="0 seconds", help="between micro-batches; 'once' takes what is there")
    parser.add_argument("--strict-order", action="store_true", help="hold rows until the watermark has passed them")
    return parser


def start(spark: SparkSession, argv: list[str] | None = None) -> StreamingQuery:
    args = arguments().parse_args(argv)
    source = pairs(args.source)
    cfg = JobConfig(
        source=source,
        sink=pairs(args.sink),
        checkpoint=args.checkpoint,
        table=args.table,
        interval=None if args.interval == "once" else args.interval,
        params=RuleParams.from_env(),
    )
    apply_settings(spark, streaming=True)
    if args.job == "score":
        profiles = pairs(args.profiles) or source
        return start_score_job(
            spark, cfg, lambda: read_merchants(spark, profiles), lambda: read_accounts(spark, profiles)
        )
    if args.job == "spend":
        return start_spend_job(spark, cfg)
    return start_anomaly_job(spark, cfg, strict_order=args.strict_order)


if __name__ == "__main__":
    start(SparkSession.builder.appName("riskweave").getOrCreate()).awaitTermination()
