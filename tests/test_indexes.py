"""Stepped rates, deep pages and search by trigrams."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from riskweave.operators.case_index import CaseIndex
from riskweave.operators.cases import newest_page, search_cases
from riskweave.operators.pages import deep_page, time_counts
from riskweave.operators.panes import stepped_counts, stepped_fraud_rate

CASES = "id string, transaction_id string, owner_name string, merchant_name string, reason_code string, classification string"


@pytest.mark.parametrize(("width", "step", "block"), [(50, 10, 5), (50, 10, 7), (10, 10, 1), (120, 40, 3), (30, 10, 2880)])
def test_stepped_counts_equal_counting_each_window(spark, width, step, block):
    rng = random.Random(width + block)
    # Times before 1970, ties, gaps longer than a window and rows without a time.
    rows = [(rng.choice(["a", "b", None]), rng.choice([rng.randrange(-300, 900), 5000 + rng.randrange(90), None])) for _ in range(300)]
    want = Counter()
    for name, at in rows:
        if at is not None:
            first = (at // step + 1) * step
            want.update((name, first + k * step) for k in range(width // step))
    df = spark.createDataFrame(rows, "name string, at bigint")
    got = stepped_counts(df, "at", width, step, ("name",), block).collect()
    assert {(r.name, r.at_ms): r.row_count for r in got} == dict(want)
    assert len(got) == len(want)


def test_stepped_counts_of_nothing_and_of_a_wrong_width(spark):
    empty = spark.createDataFrame([], "event_time_ms bigint, detected_at_ms bigint")
    assert stepped_counts(empty, "event_time_ms", 60, 20).count() == 0
    assert stepped_fraud_rate(empty, empty).count() == 0
    with pytest.raises(ValueError):
        stepped_counts(empty, "event_time_ms", 50, 20)


def test_stepped_counts_expand_panes_not_rows(spark):
    df = spark.range(200_000).select((F.col("id") % 1000).alias("at"))
    counts = stepped_counts(df, "at", 500, 100)
    assert {r.at_ms: r.row_count for r in counts.collect()} == {
        100 * k: 20_000 * min(k, 5, 15 - k) for k in range(1, 15) if min(k, 5, 15 - k) > 0
    }


@pytest.mark.parametrize("width", [100, 1000])
def test_deep_pages_equal_sorted_pages(spark, width):
    rng = random.Random(5)
    rows = [(f"{n:04d}", rng.choice([rng.randrange(-500, 5000), 777, None])) for n in range(700)]
    df = spark.createDataFrame(rows, "id string, detected_at_ms bigint")
    counts = time_counts(df, width_ms=width).persist()
    for limit, offset in ((10, 0), (25, 130), (300, 200), (7, 690), (40, 460), (5, 700), (700, 0)):
        got = deep_page(df, counts, limit, offset, width_ms=width).collect()
        ordered = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
        assert [tuple(r) for r in got] == ordered[offset : offset + limit]
        if offset == 0 and limit < 50:
            assert got == newest_page(df, limit, offset).collect()
    assert deep_page(df.limit(0), counts.limit(0), 10, 0, width_ms=width).count() == 0


def test_a_deep_page_reads_and_sorts_its_bins_only(spark, tmp_path):
    rows = spark.range(0, 200_000, 1, 8).select(F.format_string("%06d", "id").alias("id"), (F.col("id") * 1000).alias("detected_at_ms"))
    rows.write.parquet(str(tmp_path / "rows"))
    stored = spark.read.parquet(str(tmp_path / "rows"))
    page = deep_page(stored, time_counts(stored), 50, 150_000)
    assert [r.detected_at_ms for r in page.collect()] == [(199_999 - n) * 1000 for n in range(150_000, 150_050)]
    plan = page._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(detected_at_ms," in plan and "LessThan(detected_at_ms," in plan
    skipped = [int(part.split()[0].rstrip(",)")) for part in plan.split("Offset ")[1:] if part.split()[0].rstrip(",)").isdigit()]
    assert all(n < 3600 for n in skipped)  # rows of the page's own hour at most


def case_rows(spark, count=300):
    rng = random.Random(9)
    names = ["Ann Lee", "ÉMILE Zola", "aba", "ab", "", None, "abab abba", "李小龙先生", "x" * 5000]
    rows = [
        (f"c{n}", f"{n:06d}", rng.choice(names), rng.choice(["Shop A", "shop b", None]), rng.choice(["VELOCITY", "GEO_TRAVEL"]), rng.choice(["A", "B", None]))
        for n in range(count)
    ]
    return spark.createDataFrame(rows, CASES)


def test_search_by_trigrams_equals_the_scan(spark, tmp_path):
    cases = case_rows(spark)
    index = CaseIndex(spark, str(tmp_path), cases.schema, parts=8, slots=8)
    index.write(cases)
    index.write(cases)  # in place of the first
    for text in ("", "a", "ab", "aba", "abba", "ABAB", "émile", "小龙先", "velo", "shop", "000123", "none at all", "city geo", "xxxx"):
        for label in (None, "A"):
            want = sorted(r.id for r in search_cases(cases, text, label).collect())
            found = index.search(text, label)
            assert sorted(r.id for r in found.collect()) == want, text
            assert found.columns == cases.columns


def test_search_by_trigrams_reads_matching_parts(spark, tmp_path):
    cases = case_rows(spark, 2000)
    index = CaseIndex(spark, str(tmp_path), cases.schema, parts=16, slots=16)
    index.write(cases)
    found = index.search("001234")
    assert [r.id for r in found.collect()] == ["c1234"]
    own = index._rows().where(F.col("id") == "c1234").select("part").first()[0]
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and f"= {own})" in plan


def test_search_of_no_cases(spark, tmp_path):
    cases = case_rows(spark).limit(0)
    index = CaseIndex(spark, str(tmp_path), cases.schema)
    index.write(cases)
    assert index.search("abc").count() == 0 and index.search("").count() == 0
