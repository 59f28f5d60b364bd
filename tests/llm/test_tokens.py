"""Tokenization against the libraries, on the test tables and on odd texts."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import PATTERN
from tokenizers import Tokenizer

from riskweave.llm import shards
from riskweave.llm.pieces import encode_texts, pieces
from riskweave.llm.queries import tokenizer
from riskweave.llm.token_counts import byte_counts, byte_signs, token_counts
from tests.llm.frames import EDGES, documents, table

PIECES, BYTES, RANKS = tokenizer("piece_bpe_32k.model"), tokenizer("byte_bpe_50k.json"), tokenizer("byte_bpe_50k.tiktoken")
SCRAPS = [" ", "  ", "\n", "\t", "▁", "a", "e", "th", "ing", "'s", "'ll", "é", "ß", "中", "😀", "<|endoftext|>", "<s>", "<unk>",
          "<0x0A>", "12", "!!", "\x1c", "\x85", "\xa0", "　", "²", "ⅷ", "न", "्", "́", "aaaa", "\x00", "Ω", "~~", "--", "_"]
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PIECES)
COUNTER = Tokenizer.from_file(BYTES)


def odd_texts(count: int) -> list[str]:
    draw = random.Random(3)
    return ["".join(draw.choice(SCRAPS) for _ in range(draw.randint(0, 40))) for _ in range(count)]


def plain_ids(text: str) -> list[int]:
    return COUNTER.encode(text, add_special_tokens=False).ids


def test_pieces_of_odd_texts():
    model = pieces(PIECES)
    for text in odd_texts(3000) + ["=" * 700, "a" * 3000, " " * 99]:
        ids = LIBRARY.encode(text)
        assert model.encode(text) == ",".join(map(str, ids)), repr(text)
        assert model.decode(model.encode(text)) == LIBRARY.decode(ids), repr(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_pieces_and_counts_of_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    assert pieces(PIECES).encode(text) == ",".join(map(str, LIBRARY.encode(text)))
    assert byte_counts(BYTES).count(text) == len(plain_ids(text))


@pytest.mark.parametrize("ids", [[29871], [0], [1, 2], [229, 187, 173], [229, 3], [259, 259], [1, 450], [35], [0, 450]])
def test_decoding_of_any_ids(ids):
    assert pieces(PIECES).decode(",".join(map(str, ids))) == LIBRARY.decode(ids)


def test_counts_and_prefixes_of_odd_texts():
    model, signs = byte_counts(BYTES), byte_signs()
    for k, text in enumerate(odd_texts(3000)):
        found = COUNTER.encode(text, add_special_tokens=False)
        assert model.count(text) == len(found.ids), repr(text)
        budget = k % 7
        if len(found.ids) > budget:
            size = sum(len(t.encode()) if t == "<|endoftext|>" else len(t) for t in found.tokens[:budget])
            assert all(c in signs for t in found.tokens for c in t if t != "<|endoftext|>")
            assert model.cut_at(text, budget) == size, (text, budget)


def test_prefix_counts_of_a_word():
    word = "internationalisation"
    counts = byte_counts(BYTES).prefix_counts(word)
    assert counts == [len(plain_ids(word[:k])) for k in range(len(word) + 1)]


def test_whole_tables(spark):
    docs = table(spark, "sf0.001", "documents").unionByName(documents(spark))
    texts = [r[0] or "" for r in docs.select("text").collect()]
    made = encode_texts(docs, PIECES).collect()
    assert [r.ids for r in made] == LIBRARY.encode(texts)
    assert [r.decoded for r in made] == LIBRARY.decode([r.ids for r in made])
    for row in made[:50]:
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, row.ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(row.decoded.encode()).hexdigest()
        assert row.n_tokens == len(row.ids)
    counted = token_counts(docs, BYTES).collect()
    assert [r.n_tokens for r in counted] == [len(plain_ids(t)) for t in texts]
    assert [r.n_bytes for r in counted] == [len(t.encode()) for t in texts]
    assert all(r.over_limit == (r.n_tokens > 1024) for r in counted)


def test_clashing_columns_and_empty_tables(spark):
    docs = documents(spark, clashing=True)
    assert encode_texts(docs, PIECES, with_ids=False).count() == token_counts(docs, BYTES).count() == len(EDGES)
    none = documents(spark, [])
    assert encode_texts(none, PIECES).count() == token_counts(none, BYTES).count() == 0


def test_permutation_is_one_to_one():
    for size in (1, 2, 3, 100, 1025):
        assert sorted(shards.Permutation(size, 1)(np.arange(size))) == list(range(size))
    assert (shards.Permutation(500, 1)(np.arange(500)) != shards.Permutation(500, 2)(np.arange(500))).any()


def test_shards_hold_every_sequence(spark, tmp_path):
    docs = documents(spark, clashing=True)
    folder = str(tmp_path / "a")
    count = shards.write_shards(docs, RANKS, PATTERN, folder, end=50_256, length=64, shard_bytes=300_000)
    index = shards.read_index(spark, folder, 64).orderBy("slot").collect()
    assert count > 1 and [r.slot for r in index] == list(range(len(index)))
    model, wanted = shards.encoding(RANKS, PATTERN), []
    for doc_id, text, *_ in EDGES:
        ids = np.array([*model.encode_ordinary(text or ""), 50_256], "<u2")
        wanted += [(doc_id, k, len(ids[a : a + 64]), hashlib.sha256(ids[a : a + 64].tobytes()).hexdigest()) for k, a in enumerate(range(0, len(ids), 64))]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.sequence, r.n_tokens, r.ids_sha256) for r in index), key=key) == sorted(wanted, key=key)
    # Reading may start at any record.
    shard = [r for r in index if r.shard == index[-1].shard]
    resumed = shards.read_from(spark, folder, shard[0].shard, 1, 2, length=64)
    assert [hashlib.sha256(ids.tobytes()).hexdigest() for ids in resumed] == [r.ids_sha256 for r in shard[1:3]]
    # The order follows from the key and the documents alone.
    shards.write_shards(docs.repartition(3), RANKS, PATTERN, str(tmp_path / "b"), end=50_256, length=64, shard_bytes=300_000)
    assert shards.read_index(spark, str(tmp_path / "b"), 64).orderBy("slot").collect() == index
    shards.write_shards(docs, RANKS, PATTERN, str(tmp_path / "c"), end=50_256, length=64, shard_bytes=300_000, key=9)
    other = shards.read_index(spark, str(tmp_path / "c"), 64).orderBy("slot").collect()
    assert [r.doc_id for r in other] != [r.doc_id for r in index] and len(other) == len(index)


def test_order_of_an_empty_table(spark):
    docs = documents(spark)
    some, none = (shards.training_order(d, RANKS, PATTERN, end=50_256) for d in (docs, docs.limit(0)))
    assert none.count() == 0 and none.dtypes == some.dtypes


def test_rows_without_an_id_of_their_own_fill_all_shards(spark, tmp_path, monkeypatch):
    """Null and repeated ids, different and equal texts: all of them, evenly, in an order that the rows alone decide."""
    monkeypatch.setattr(shards, "COPIES", 100)
    monkeypatch.setattr(shards, "RECORDS", 150)
    rows = [(None, f"text {i}", "en", "s", 0) for i in range(900)] + [(7, f"some {i}", "en", "s", 0) for i in range(900)]
    rows += [(None, None, "en", "s", 0)] * 900 + [(8, "copy " * 200, "en", "s", 0)] * 900 + [(100 + i, "own", "en", "s", 0) for i in range(50)]
    docs = documents(spark, rows)
    write = dict(end=50_256, length=64, shard_bytes=60_000)
    count = shards.write_shards(docs, RANKS, PATTERN, str(tmp_path / "a"), **write)
    index = shards.read_index(spark, str(tmp_path / "a"), 64).orderBy("slot").collect()
    assert [r.slot for r in index] == list(range(len(index)))
    per_doc = -(-(len(shards.encoding(RANKS, PATTERN).encode_ordinary("copy " * 200)) + 1) // 64)
    assert Counter(r.doc_id for r in index) == {None: 1800, 7: 900, 8: 900 * per_doc} | {100 + i: 1 for i in range(50)}
    for doc_id in (None, 7, 8):
        per_shard = Counter(r.shard for r in index if r.doc_id == doc_id)
        assert len(per_shard) == count > 10 and max(per_shard.values()) <= 2 * sum(per_shard.values()) / count + 10
    shards.write_shards(docs.repartition(3), RANKS, PATTERN, str(tmp_path / "b"), **write)
    assert shards.read_index(spark, str(tmp_path / "b"), 64).orderBy("slot").collect() == index


def test_order_of_ids_spread_wide(spark, tmp_path):
    ids = [-(1 << 63), -5, 0, 3, (1 << 63) - 1]
    docs = documents(spark, [(i, f"text {i}", "en", "s", 0) for i in ids])
    shards.write_shards(docs, RANKS, PATTERN, str(tmp_path / "a"), end=50_256)
    index = shards.read_index(spark, str(tmp_path / "a")).collect()
    assert sorted(r.doc_id for r in index) == ids and sorted(r.slot for r in index) == list(range(5))
