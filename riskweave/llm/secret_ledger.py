"""Secret scans with a ledger of what has been scanned.

Every version of every file is known by the hash of its content, its blob. The ledger says which blob was
scanned by which version of which rule, and what was found. A scan reads only blobs that some rule's
current version hasn't seen, each once however many paths hold it, and adds to the ledger; the findings are
then joined to all paths. Only DataFrame functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import store


@dataclass(frozen=True)
class Rule:
    """A regular expression; a match counts if its ``group`` has ``least`` characters. A change needs a new version."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1


#: The base rules, in the order in which spans with the same start are listed.
BASE = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    # A run of 24 or more starts where the run starts, so shorter runs needn't be matched first.
    Rule("hex", 1, r"[0-9a-f]{24,}"),
)
MORE = (
    # Nothing is tried twice, and a run of token signs only from its start, so long texts take time in proportion.
    Rule("pem", 2, r"-----BEGIN (?:(?!PRIVATE KEY-----)[A-Z]++ ){0,8}+PRIVATE KEY-----"),
    Rule("jwt", 2, r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]++"),
)
LEDGER = "blob string, rule string, version int, spans array<struct<start: int, end: int>>"


def spans(text: Column, rule: Rule) -> Column:
    """Matches that count as (start, end), in code points, from the gaps between all matches."""
    pattern = F.lit(rule.pattern)
    gaps = F.split(text, rule.pattern, -1)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    tested = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    matches = F.zip_with(whole, tested, lambda w, t: F.struct(F.length(w).alias("size"), F.length(t).alias("tested")))
    # One more gap than matches; the last one is of no use.
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(whole)), matches, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("m")))
    none = F.expr("cast(array() as array<struct<start: int, end: int>>)")
    start = F.struct(F.lit(0).alias("at"), none.alias("found"))

    def step(state: Column, pair: Column) -> Column:
        begin = state["at"] + pair["gap"]
        end = begin + pair["m"]["size"]
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(
            end.alias("at"),
            F.when(pair["m"]["tested"] >= rule.least, F.concat(state["found"], span)).otherwise(state["found"]).alias("found"),
        )

    return F.when(text.rlike(rule.pattern), F.aggregate(pairs, start, step)["found"]).otherwise(none)


def blob_of(text: Column) -> Column:
    """Content address of a text; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scan(docs: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...]) -> DataFrame:
    """New ledger rows: what each rule that hasn't seen a blob finds in it (blob, rule, version, spans)."""
    blobs = docs.select(blob_of(F.col("text")).alias("blob"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    blobs = blobs.dropDuplicates(["blob"])
    current = F.array(*[F.lit(f"{r.kind} {r.version}") for r in rules])
    if ledger is None:
        blobs = blobs.withColumn("todo", current)
    else:
        # At most one entry per rule and version, so the set is small.
        seen = ledger.select("blob", F.concat_ws(" ", "rule", "version").alias("name")).groupBy("blob").agg(F.collect_set("name").alias("seen"))
        todo = F.array_except(current, F.coalesce(F.col("seen"), F.expr("cast(array() as array<string>)")))
        blobs = blobs.join(seen, "blob", "left").withColumn("todo", todo).where(F.size("todo") > 0)
    results = [
        F.when(
            F.array_contains("todo", f"{r.kind} {r.version}"),
            F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"), spans(F.col("text"), r).alias("spans")),
        )
        for r in rules
    ]
    found = blobs.select("blob", F.explode(F.filter(F.array(*results), lambda x: x.isNotNull())).alias("r"))
    return found.select("blob", "r.rule", "r.version", "r.spans")


def findings(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...], base: int = len(BASE)) -> DataFrame:
    """What the ledger holds for every path: (doc_id, n_<kind> of the first ``base`` rules, base_sha256, spans).

    Spans are kind:start:end by start, then in the order of ``rules``. One row per row of ``docs``.
    """
    order = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules))):
        order = F.when((F.col("rule") == rule.kind) & (F.col("version") == rule.version), k).otherwise(order)
    held = ledger.withColumn("_rule", order).where(F.col("_rule").isNotNull() & (F.size("spans") > 0))
    placed = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("_rule").alias("rule"), s["end"].alias("end")))
    per_blob = held.select("blob", placed.alias("placed")).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("placed"))).alias("all"))
    none = F.expr("cast(array() as array<struct<start: int, rule: int, end: int>>)")
    paths = docs.select("doc_id", blob_of(F.col("text")).alias("blob"))
    joined = paths.join(per_blob, "blob", "left").withColumn("all", F.coalesce("all", none))
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.element_at(kinds, s["rule"] + 1), s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("all", lambda s: s["rule"] == k)).cast("long")
    counts = [count(k).alias(f"n_{r.kind}") for k, r in enumerate(rules[:base])]
    return joined.select(
        "doc_id", *counts, F.sha2(listed(F.filter("all", lambda s: s["rule"] < base)), 256).alias("base_sha256"), listed(F.col("all")).alias("spans")
    )


def scan_all(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Findings of all rules in every row of ``docs``; ``ledger`` is what earlier scans have stored."""
    rules = BASE + MORE
    new = store(scan(docs, ledger, rules), "ledger")
    return findings(docs, new if ledger is None else ledger.unionByName(new), rules)
