"""Word ids, ranked search and phrases against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskweave.llm import block_max, frequent, phrases, word_table
from riskweave.llm.queries import tokenizer
from riskweave.llm.word_bytes import byte_kinds, words_of
from tests.llm.frames import EDGES, documents, table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- words of a batch ------------------------------------------------------------------------


def test_words_on_bytes_equal_a_pattern():
    rng = random.Random(5)
    texts = ["".join(rng.choice("aB é.;\n\t😀") for _ in range(rng.randrange(12))) for _ in range(300)] + [""]
    found = words_of(pa.array(texts), byte_kinds(b" \t", b".;\n"))
    got = defaultdict(lambda: defaultdict(list))
    for row, piece, word in zip(found.row, found.piece, found.words.to_pylist(), strict=True):
        got[row][piece].append(word.decode())
    for i, text in enumerate(texts):
        expected = [w for p in re.split(r"[.;\n]", text.translate(LOWER)) if (w := re.findall(r"[^ \t]+", p))]
        assert list(got[i].values()) == expected


# ---- word ids --------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer("word_bpe_49k.json"))


def expected_words(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))


@pytest.mark.parametrize("held_bytes", [word_table.HELD_BYTES, 3_000, 0])
def test_word_ids_equal_the_library_however_many_words_are_broadcast(spark, library, held_bytes):
    marks = [(20, "a<|endoftext|>b <|startoftext|><|endoftext|>", "en", "a", 1), (21, "Σίσυφος ΣΑΣ İstanbul é 가 字字 K", "en", "a", 1)]
    rows = EDGES + marks
    got = word_table.encode_words(documents(spark, rows, clashing=True), tokenizer("word_bpe_49k.json"), held_bytes)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert Counter(map(tuple, got.collect())) == Counter((r[0], *expected_words(library, r[1])) for r in rows)


def test_words_equal_the_library_on_any_characters(library):
    model, rng = word_table.word_tokenizer(tokenizer("word_bpe_49k.json")), random.Random(11)
    signs = list("ab cS'tTe\n .,9²½İßΣσ́̇ÀƁ\x85\xa0\x1c\x1f—’eͅ字😀한가ǅªɅ՘K​")
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(15))) for _ in range(3000)]
    texts += [f"a{chr(c)}!b{chr(c)}" for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    for text in texts:
        assert [i for w in model.words(text) for i in model.ids(w)] == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_every_distinct_word_is_encoded_once(spark):
    got = word_table.distinct_words(documents(spark), tokenizer("word_bpe_49k.json")).collect()
    assert len({r["word"] for r in got}) == len(got)
    assert {r["word"]: r["n"] for r in got}["quick"] == 3


def test_words_are_found_in_two_passes_over_the_texts(spark):
    """Counted once, and looked up once: both sides of the join read one shuffle of the rows."""
    rows = [(i, f"w{i} the quick w{i % 7} " * 5, "en", "a", 1) for i in range(300)]
    got = word_table.encode_words(documents(spark, rows), tokenizer("word_bpe_49k.json"), 1_000)
    assert len(got.collect()) == 300
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("MapInArrow places") == 1 and "ReusedExchange" in plan and plan.count("MapInArrow others") == 1


@pytest.mark.parametrize("at_once", [word_table.AT_ONCE, 4])
def test_rows_finish_with_the_ids_of_their_own_words(library, monkeypatch, at_once):
    monkeypatch.setattr(word_table, "AT_ONCE", at_once)
    model = word_table.word_tokenizer(tokenizer("word_bpe_49k.json"))
    held = word_table._Held(model, [(w, model.ids(w)) for w in ("the", "quick", "unquestionably")])
    texts = ["the quick the", "", "quick brown unquestionably strange the", "odd"]
    numbers = [held.numbers(model.words(t)) for t in texts]
    own = [model.ids(w) for w in ("brown", "strange", "odd")]
    got = held.finish(numbers, np.array(sum(own, []), np.int32), word_table._starts(map(len, own)))
    assert got == [expected_words(library, t) for t in texts]
    with pytest.raises(ValueError):
        held.finish(numbers, np.array(own[0] + own[1], np.int32), word_table._starts(map(len, own[:2])))


def test_word_ids_of_an_empty_table(spark):
    assert word_table.encode_words(documents(spark, []), tokenizer("word_bpe_49k.json")).count() == 0


# ---- ranked search ---------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_ranking(docs, items, k):
    counts = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    number, total = len(counts), sum(c.total() for _, c in counts)
    holding = Counter(t for _, c in counts for t in c)
    rows = []
    for item, text in items:
        scored = []
        for d, c in counts:
            m = 100 - 90 + 90 * c.total() * number // total
            weight = lambda t: math.floor(1000 * math.log((2 * number + 2) / (2 * holding[t] + 1)))
            score = sum(weight(t) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(TERM.findall((text or "").translate(LOWER))) if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        rows += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k], 1)]
    return rows


@pytest.mark.parametrize("item_bytes", [block_max.ITEM_BYTES, 60])
def test_search_equals_scoring_every_document(spark, item_bytes):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)] + ["é", "x9"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randrange(1, 60)))) for i in range(3000)]
    docs += [(i, docs[0][1]) for i in range(3000, 3030)]  # ties
    docs += [(None, docs[0][1]), (None, None), (4000, ""), (4001, " ,.;"), (5, "w1 w1"), (4002, "W1 w2-w3 " * 3000)]
    items = [(i, " ".join(rng.choices(words, k=8))) for i in range(12)] + [(12, docs[0][1]), (13, None), (14, "nowhere"), (14, "w1 W1 w2"), (None, "é")]
    frame = documents(spark, [(d, t, "en", "a", 1) for d, t in docs], clashing=True).repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumns({"key": F.lit("k"), "score": F.lit("s")})
    got = block_max.rank_documents(frame, asked, 10, item_bytes)
    assert [f.dataType.simpleString() for f in got.schema.fields] == ["bigint", "int", "bigint", "bigint"]
    assert Counter(map(tuple, got.collect())) == Counter(plain_ranking(docs, items, 10))


def test_search_of_empty_tables(spark):
    items = spark.createDataFrame([(1, "a word")], "item_id long, text string")
    assert block_max.rank_documents(documents(spark, []), items).count() == 0
    assert block_max.rank_documents(documents(spark), items.limit(0)).count() == 0


def test_blocks_are_ruled_out_by_their_maximum():
    rng, norms = np.random.default_rng(1), np.full(20_000, 100)
    # The common list is worth much in its first and its last blocks, and less between them.
    common = np.where(np.arange(20_000) < 2048, 3, np.where(np.arange(20_000) > 19_900, 40, 1))
    lists = []
    for share, weight, counts in ((0.6, 100, common), (0.05, 9000, np.ones(20_000, np.int64))):
        docs = np.flatnonzero(rng.random(len(norms)) < share)
        packed = block_max.pack(docs, counts[docs], norms)
        lists.append((weight, block_max.Postings(*(np.array(packed[c]) for c in ("lasts", "maxima", "starts")), packed["data"], norms)))
    best, seen = block_max.Best(10), {"ruled out": 0}
    block_max.search_shard(lists, list(range(len(norms))), best, seen)
    unpacked = [len(postings.unpacked) for _, postings in lists]
    total = np.zeros(len(norms), np.int64)
    for weight, postings in lists:
        docs, worth = postings.between(0, len(norms))
        total[docs] += weight * worth
    order = np.lexsort((np.arange(len(norms)), -total))[:10]
    assert [(-s, d) for s, _, d in best.found] == [(int(total[d]), int(d)) for d in order]
    assert seen["ruled out"] > 50 and unpacked[0] < len(lists[0][1].lasts) // 2


# ---- phrases ---------------------------------------------------------------------------------


def plain_phrases(rows, threshold, longest, first):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        totals[lang] += 0
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall(r"[^ \t]+", piece)
            totals[lang] += len(words)
            counts.update((lang, *words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    some = {g: a for g, a in counts.items() if len(g) > 2 and a >= threshold}
    inside = defaultdict(int)
    for g, a in some.items():
        for k in range(2, len(g) - 1):
            for i in range(1, len(g) - k + 1):
                key = (g[0], *g[i : i + k])
                inside[key] = max(inside[key], a)
    out = []
    for lang in totals:
        scored = []
        for g, a in some.items():
            if g[0] == lang and inside[g] < a:
                cuts = [(1000 * a * totals[lang] // (counts[g[: k + 1]] * counts[(lang, *g[k + 1 :])]), k) for k in range(1, len(g) - 1)]
                score, k = min(cuts)
                scored.append((-score, -a, " ".join(g[1:]).encode(), counts[g[: k + 1]], counts[(lang, *g[k + 1 :])]))
        out += [(lang, r, p.decode(), -a, left, right, totals[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(scored)[:first], 1)]
    return out


@pytest.mark.parametrize(("threshold", "first"), [(8, 2000), (20, 15)])
def test_phrases_equal_a_plain_count(spark, threshold, first):
    rng = random.Random(9)
    words = [f"W{i}é" for i in range(25)] + ["a", "b"]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = []
    for i in range(900):
        text = " ".join(rng.choices(words, weights, k=rng.randrange(0, 40)))
        text += rng.choice(["", ". the same five words here, ", "\tthe same five words here", "; new york city"])
        rows.append((i, text, rng.choice(["en", "en", "de", None, "und"]), "s", 1))
    rows += [(1, None, "en", "s", 1), (None, "", "fr", None, 0), *[(7, "new york city hall", "en", "s", 1)] * 30, (8, "x y " * 400, "en", "s", 1)]
    frame = documents(spark, rows, clashing=True).repartition(6)
    got = phrases.collocations(frame, threshold, first=first, part_bytes=1000)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    expected = plain_phrases([(r[1], r[2]) for r in rows], threshold, 5, first)
    assert len(expected) > 20
    assert Counter(map(tuple, got.collect())) == Counter(expected)


def test_phrases_of_an_empty_table(spark):
    assert phrases.collocations(documents(spark, [])).count() == 0
    assert phrases.collocations(documents(spark)).where("lang = 'en' and a < 100").count() == 0


def test_phrases_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(phrases.xxhash, "xxh3_64_intdigest", lambda x, seed=0: 7)
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["a b a b c", "a b"]), "lang": pa.array(["x", "y"])})
    grams = phrases.Grams(batch)
    found = [row for k, s, h in grams.of_lengths(2) for row in grams.counted(k, s, h).to_pylist()]
    assert sorted((r["lang"], r["phrase"], r["n"]) for r in found) == sorted(
        [("x", "a", 2), ("x", "b", 2), ("x", "c", 1), ("y", "a", 1), ("y", "b", 1), ("x", "a b", 2), ("x", "b a", 1), ("x", "b c", 1), ("y", "a b", 1)]
    )


def test_a_task_hands_on_a_phrase_once(spark):
    rows = [(i, "new york city hall. a b", "en" if i % 2 else None, "s", 1) for i in range(6000)]
    texts = phrases._texts(documents(spark, rows).repartition(12))
    every = frequent.Filter(8, [(1, b"\xff")])
    made = phrases._occurrences(texts, every, every, 5, 2).withColumn("task", F.spark_partition_id()).collect()
    assert len({r["task"] for r in made}) == 2  # three batches each
    assert max(Counter((r["task"], r["lang"], r["phrase"]) for r in made).values()) == 1
    found = Counter()
    for r in made:
        found[r["lang"], r["phrase"], r["words"]] += r["n"]
    words = ["new", "york", "city", "hall"]
    expected = {(" ".join(words[i : i + k]), k) for k in range(1, 5) for i in range(5 - k)} | {("a", 1), ("b", 1), ("a b", 2)}
    assert found == {(lang, p, k): 3000 for lang in ("en", "und") for p, k in expected}


def test_counts_held_are_bounded():
    rng = np.random.default_rng(8)
    batches = [
        pa.RecordBatch.from_pydict(
            {
                "lang": pa.array(["en"] * 500),
                "phrase": pa.array([f"w{x}" for x in rng.integers(0, 900, 500)]),
                "words": pa.array(np.ones(500, np.int32)),
                "n": pa.array(rng.integers(1, 9, 500)),
            }
        )
        for _ in range(30)
    ]
    sums = lambda some: Counter() + sum((Counter({r["phrase"]: r["n"]}) for b in some for r in b.to_pylist()), Counter())
    once, parts = list(phrases.added_up(iter(batches))), list(phrases.added_up(iter(batches), 2 * batches[0].nbytes))
    assert sum(b.num_rows for b in once) == len(sums(batches)) < sum(b.num_rows for b in parts)
    assert sums(once) == sums(parts) == sums(batches)
    assert max(b.num_rows for b in parts) <= 1500
    assert list(phrases.added_up(iter([]))) == []


def test_summaries_keep_all_that_is_frequent(spark):
    rng = np.random.default_rng(4)
    numbers = rng.zipf(1.3, 200_000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    parts = 4
    mass = np.bincount(frequent.part_of(numbers, parts), minlength=parts)
    capacities = mass // 100 + 1
    pieces = spark.createDataFrame([(i,) for i in range(40)], "i int").repartition(40)

    def local(batches):
        for batch in batches:
            for i in batch.column("i").to_pylist():
                yield from frequent.local_rows(iter([numbers[i::40]]), capacities)

    got = frequent.frequent(pieces.mapInArrow(local, frequent.SCHEMA), capacities, 100)
    kept = {r[0] % (1 << 64) for r in got.collect()}
    values, counts = np.unique(numbers, return_counts=True)
    assert set(values[counts >= 100].tolist()) <= kept
    assert len(kept) <= capacities.sum() and len(kept) < len(values)
    passes = frequent.filter_of(got)
    assert passes(values[counts >= 100]).all()
    assert passes(rng.integers(0, 1 << 63, 10_000, dtype=np.uint64)).mean() < 0.05


def test_a_summary_misses_no_more_than_its_error():
    rng = np.random.default_rng(6)
    summary, true = frequent.Summary(50), Counter()
    for _ in range(60):
        some, n = np.unique(rng.zipf(1.5, 2000).astype(np.uint64), return_counts=True)
        true.update(dict(zip(some.tolist(), n.tolist(), strict=True)))
        summary.add(some, n)
        summary.settle()
    held = dict(zip(summary.numbers.tolist(), summary.counts.tolist(), strict=True))
    assert len(held) <= 50 and summary.error <= sum(true.values()) / 51
    assert all(0 <= n - held.get(g, 0) <= summary.error for g, n in true.items())


def test_phrases_and_search_on_given_tables_run(spark):
    docs = table(spark, "sf0.001", "documents")
    assert block_max.rank_documents(docs, table(spark, "sf0.001", "benchmark")).count() > 0
