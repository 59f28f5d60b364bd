"""Copies, similarity joins and nearest neighbours against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from riskweave.llm import chunk_recipes, count_tree, vantage
from riskweave.llm.common import flat_bytes
from riskweave.llm.components import components
from tests.llm.frames import EDGES, LONG, documents, table


def plain_copies(rows: list[tuple]) -> dict:
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    return {hashlib.sha256(t.encode()).hexdigest(): (min((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}


@pytest.mark.parametrize("size", [16, 1])
def test_exact_copies(spark, size):
    """One byte of fingerprint makes different chunks meet, and must not change the groups."""
    rows = [tuple(r) for r in table(spark, "sf0.001", "documents").collect()] + EDGES
    rows += [(1000 + i, rows[i][1].replace(" ", "  "), "en", "s", 0) for i in range(40)]
    found = chunk_recipes.exact_groups(documents(spark, rows, clashing=True), size).collect()
    wanted = plain_copies(rows)
    assert len(found) == len(rows)
    for r in found:
        assert (r.keep_id, r.group_size) == wanted[r.text_sha256]
    assert sum(r.kept for r in found) == len(wanted)
    assert all(r.doc_id == r.keep_id for r in found if r.kept)


def test_chunks_depend_on_the_text_alone():
    texts = [LONG, "ab" * 30_000, "", "x" * 40_000, LONG[:511], LONG[:513]]
    raw, starts = flat_bytes(pa.array(texts))
    together = chunk_recipes.chunk_ends(raw, starts)
    for text, start, ends in zip(texts, starts, together, strict=False):
        alone = chunk_recipes.chunk_ends(*flat_bytes(pa.array([text])))[0]
        assert alone == [e - start for e in ends] and (not text or alone[-1] == len(text))
        sizes = np.diff([0, *alone])
        assert (sizes <= chunk_recipes.LARGEST).all() and (sizes[:-1] >= chunk_recipes.SMALLEST).all()
    # An insertion at the front leaves later chunks as they are.
    moved = chunk_recipes.chunk_ends(*flat_bytes(pa.array(["inserted " + LONG])))[0]
    assert len(set(moved) & {e + 9 for e in together[0]}) > len(together[0]) // 2


def test_dropping_copies(spark):
    docs = documents(spark, clashing=True)
    kept = chunk_recipes.drop_copies(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert len(rows) == len(plain_copies(EDGES)) and {r.doc_id for r in rows} == {1, 2, 4, 6, 7, 8, 9, 10, None}
    assert chunk_recipes.drop_copies(documents(spark, [])).count() == 0


def plain_grams(text: str | None, size: int) -> set:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def plain_components(rows: list[tuple], size: int, part: int) -> dict:
    sets = {i: plain_grams(t, size) for i, t, *_ in rows}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and min(len(sets[x]), len(sets[y])) * 100 >= part * max(len(sets[x]), len(sets[y])):
                both = len(sets[x] & sets[y])
                if 100 * both >= part * (len(sets[x]) + len(sets[y]) - both):
                    a, b = sorted((top(x), top(y)))
                    up[b] = a
    return {i: (len(s), top(i)) for i, s in sets.items()}


def near_copies() -> list[tuple]:
    """Copies with some words changed: chains that link step by step, and groups that only share blocks."""
    draw = random.Random(4)
    rows, base = [], [f"w{draw.randint(0, 10**6)}" for _ in range(220)]
    for i in range(120):
        words = list(base)
        for _ in range(draw.randint(0, 4)):
            words[draw.randrange(len(words))] = f"n{draw.randint(0, 10**6)}"
        rows.append((i, " ".join(words), "en", "s", 0))
    chain = list(base)
    for i in range(200, 230):
        chain[(i * 37) % len(chain)] = f"c{i}"
        rows.append((i, " ".join(chain), "en", "s", 0))
    for i in range(300, 360):  # sizes around the first band
        words = [f"t{k}" for k in range(draw.randint(8, 16))]
        words[draw.randrange(len(words))] = draw.choice(["t0", "x", "y"])
        rows.append((i, " ".join(words).title(), "en", "s", 0))
    return rows


@pytest.mark.parametrize(("size", "part"), [(3, 90), (5, 80)])
def test_jaccard_components(spark, size, part):
    rows = [(r[0] + 10_000, *tuple(r)[1:]) for r in table(spark, "sf0.001", "documents").collect()]
    rows += [r for r in EDGES if r[0] is not None][:5] + EDGES[6:12] + near_copies()
    found = count_tree.jaccard_components(documents(spark, rows, clashing=True), size, part).collect()
    wanted = plain_components(rows, size, part)
    assert len(found) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == wanted


def test_jaccard_of_rows_without_id_and_of_nothing(spark):
    rows = [(None, "a b c d", "en", "s", 0), (None, "a b c d", "en", "s", 0), (7, "a B c d", "en", "s", 0), (7, "a B c d", "en", "s", 0), (None, None, None, None, None)]
    found = count_tree.jaccard_components(documents(spark, rows)).collect()
    assert sorted(map(str, found)) == sorted(f"Row(doc_id={i}, n_shingles={n}, component_id={c})" for i, n, c in [(None, 2, 7), (None, 2, 7), (7, 2, 7), (7, 2, 7), (None, 0, None)])
    assert count_tree.jaccard_components(documents(spark, [])).count() == 0
    docs = documents(spark, rows, clashing=True)
    assert count_tree.keep_one(docs).columns == docs.columns and count_tree.keep_one(docs).count() == 5


def test_tree_finds_what_a_scan_finds():
    draw = np.random.default_rng(2)
    base = draw.poisson(3, (30, count_tree.GROUPS))
    points = np.maximum(base[draw.integers(0, 30, 900)] + draw.integers(-1, 2, (900, count_tree.GROUPS)) * (draw.random((900, count_tree.GROUPS)) < 0.1), 0)
    sizes, group, rule = points.sum(axis=1), np.arange(900), count_tree.Threshold(90, 100)
    i, j, _ = count_tree.partners(points, sizes, group, rule, None)
    bound = np.minimum(points[:, None], points[None]).sum(axis=2)
    wanted = {(a, b) for a, b in zip(*np.nonzero(bound >= rule.shared(sizes[:, None] + sizes[None])), strict=True) if a != b}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == wanted and wanted


@pytest.mark.parametrize("part", [80, 90])
def test_linked_sets_meet_in_their_first_ngrams(part):
    """Whatever the weights are, as long as an n-gram has the same one everywhere."""
    draw, rule = np.random.default_rng(part), count_tree.Threshold(part, 100)
    linked = 0
    for _ in range(2_000):
        size = int(draw.integers(1, 60))
        own, other = draw.integers(0, max(1, size // 8) + 1, 2)
        grams = draw.permutation(200)[: size + own + other].astype(np.uint64)
        sets = [np.sort(grams[: size + own]), np.sort(np.concatenate((grams[:size], grams[size + own :])))]
        if 100 * size < part * len(grams):
            continue
        linked += 1
        weight = draw.integers(0, 5, 200).astype(np.uint8)
        x, y = (rule.first(s, weight[s.astype(int)]) for s in sets)
        assert len(np.intersect1d(x, y))
    assert linked > 200


def test_weights_count_all_rows(spark):
    texts = ["a b c"] * 40 + ["d e f", None, ""]
    made = np.frombuffer(count_tree.weights(documents(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)]), 3, 0), np.uint8)
    common, rare = (made[count_tree._counter(count_tree.ngrams(t, 3))][0] for t in ("a b c", "d e f"))
    assert common == int(count_tree.STEPS * np.log2(41)) and rare == count_tree.STEPS
    assert np.count_nonzero(made) == 2
    assert not any(count_tree.weights(documents(spark, []), 3, 0))


def test_meetings_need_no_window_over_an_ngram(spark):
    """However many sets begin with it, they are summed before they move and may be split."""
    rule = count_tree.Threshold(90, 100)
    docs = documents(spark, [r for r in near_copies() if r[0] < 300])
    met = count_tree.meetings(docs, 3, rule, 0)
    assert "Window" not in met._jdf.queryExecution().toString()
    nodes = defaultdict(set)
    for r in count_tree.first_ngrams(docs, 3, rule, 0).collect():
        nodes[r.gram].add(r.node)
    wanted, found = {frozenset(n) for n in nodes.values() if len(n) > 1}, defaultdict(set)
    for r in met.collect():
        found[r.signature, r.many].add(r.node)
    assert {frozenset(n) for n in found.values()} == wanted and len(found) == len(wanted)
    assert all(many == len(n) for (_, many), n in found.items())


def test_large_buckets_are_cut_into_chunks(spark, monkeypatch):
    monkeypatch.setattr(count_tree, "CHUNK", 20)
    rows = near_copies()[:120]
    found = count_tree.jaccard_components(documents(spark, rows), 3, 90).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == plain_components(rows, 3, 90)


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 150)] + [(7, 7), (3, 2)]
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in found} == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 150)}


def plain_nearest(rows: list[tuple], k: int) -> dict:
    kept = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    found = {}
    for i, q in kept:
        if i % 20 == 0:
            scored = sorted((-float((v * q).sum()), j) for j, v in kept if j != i and len(v) == len(q))
            found[i] = [(r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return found


def odd_vectors() -> list[tuple]:
    draw = np.random.default_rng(3)
    rows = [(i, draw.normal(size=5).tolist()) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(300, 360)]  # many copies: ties go to the smaller id
    rows += [(400, None), (420, [0.0] * 5), (440, [1.0, None, 0.0, 0.0, 0.0]), (460, [float("nan")] * 5), (480, [float("inf")] * 5), (None, [1.0] * 5), (500, [1.0, 2.0]), (501, [2.0, 1.0])]
    return rows


def test_nearest_is_exact_with_factor_one(spark):
    rows = odd_vectors()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(r[0], r[1]) for r in frame.collect()]
    found = defaultdict(list)
    for r in vantage.nearest(frame, factor=1.0, shard=100, block=7).collect():
        found[r.query_id].append((r["rank"], r.vec_id, r.score))
    wanted = plain_nearest(rows, 20)
    assert found.keys() == wanted.keys()
    for query, got in found.items():
        assert [g[:2] for g in sorted(got)] == [w[:2] for w in wanted[query]]
        assert np.allclose([g[2] for g in sorted(got)], [w[2] for w in wanted[query]], rtol=1e-12)


def test_recall_and_empty_tables(spark):
    frame = table(spark, "sf0.1", "embeddings")
    rows = [(r[0], r[1]) for r in frame.select("vec_id", "embedding").collect()]
    wanted = plain_nearest(rows, 20)
    found = vantage.nearest(frame).collect()
    hits = sum(r.vec_id in {w[1] for w in wanted[r.query_id]} for r in found)
    assert hits >= 0.95 * sum(map(len, wanted.values())) and len(found) == sum(map(len, wanted.values()))
    assert vantage.nearest(frame.limit(0)).count() == 0


def uneven_vectors(kind: str) -> list[tuple]:
    draw = np.random.default_rng(6)
    points = draw.normal(size=(6_000, 48))
    if kind == "few dimensions":
        points = draw.normal(size=(6_000, 6)) @ draw.normal(size=(6, 48))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    if kind == "lengths":
        points *= draw.lognormal(0, 0.5, (6_000, 1))
    if kind == "near copies":
        points[:3_000] = points[0] + 1e-6 * draw.normal(size=(3_000, 48))
    return [(i, v) for i, v in enumerate(points.astype(np.float32).astype(float).tolist())]


@pytest.mark.parametrize("kind", ["lengths", "few dimensions", "near copies"])
def test_no_neighbour_is_passed_over(spark, kind):
    """By default, whatever the vectors are like."""
    rows = uneven_vectors(kind)
    every, found = np.array([v for _, v in rows]), defaultdict(list)
    for r in vantage.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect():
        found[r.query_id].append(r)
    assert len(found) == 300
    for query, got in found.items():
        scores = (every * every[query]).sum(axis=1)
        scores[query] = -np.inf
        got = sorted(got, key=lambda r: r["rank"])
        assert len(got) == 20 and np.allclose([r.score for r in got], np.sort(scores)[::-1][:20], rtol=1e-14, atol=0)
        assert all(scores[r.vec_id] == pytest.approx(r.score, rel=1e-14) for r in got)
