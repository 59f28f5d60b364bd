"""Ids of texts from a table of their distinct words, and texts of ids.

The tokenizer's merges stay within a word, so each distinct word is encoded once. Words are counted over all texts, the
table of distinct words gets its ids, and the ids go back to where the words stand: a share of the table of
bounded size, the most frequent words, is broadcast; all other words are joined to the table by word, each with
its row and position, and return to their rows. Rows are dealt once with the words that aren't held, and both sides of that
join read the same shuffle. Decoding looks ids up in the table of pieces.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm.common import LATIN, small_batches, store
from riskweave.llm.token_counts import byte_signs

#: Bytes of the words that are broadcast, with what Python needs for one, and words that a task counts before it hands them on.
HELD_BYTES, ENTRY_BYTES, COUNTED = 64 << 20, 200, 200_000
#: Steps per doubling in which the frequency of the words to broadcast is chosen.
STEPS = 8

#: How hard rows are packed before they move.
PACKING = 9
#: Words whose ids are spelled out at a time.
AT_ONCE = 1 << 20

#: Characters on which this module and the library agree: no marks that combine, no letters whose lower case lies
#: elsewhere, and not the four separators of ASCII.
PLAIN = "\x00-\x1b -ſ–—‘’“”…"
_OTHER = re.compile(f"[^{PLAIN}]")


class WordTokenizer:
    """Words, ids and pieces of one tokenizer file that merges within words and joins pieces by a space."""

    def __init__(self, path: str):
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        steps = spec["pre_tokenizer"].get("pretokenizers", [])
        split = steps[0] if len(steps) == 2 else {}
        fits = split.get("type") == "Split" and split["behavior"] == "Removed" and split["invert"] and steps[1]["type"] == "ByteLevel" and not steps[1]["use_regex"]
        if not fits or spec["decoder"] is not None or spec["post_processor"] is not None:
            raise ValueError("this tokenizer doesn't cut texts into words by one pattern")
        pattern = split["pattern"]["Regex"]
        self.exact = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        # Among plain characters, after folding, the letters are the Latin ones and those listed.
        letters = f"{LATIN}ªµº"
        # A word of letters can't start where another one does, so it may be tried first.
        plain = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{letters}0-9²³¹¼½¾]").replace(r"[\p{L}]", f"[{letters}]").replace(r"[\p{N}]", "[0-9²³¹¼½¾]")
        self.plain = re.compile(f"[{letters}]+|{plain}")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        marks = sorted(self.special, key=len, reverse=True)
        self.marks = re.compile("|".join(map(re.escape, marks))) if marks else None
        self.signs = {b: s for s, b in byte_signs().items()}
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.digits = pa.array([f"{i} ".encode() for i in range(size)], pa.large_binary())
        self.pieces = pa.array([f"{self.library.id_to_token(i)} ".encode() for i in range(size)], pa.large_binary())

    def words(self, text: str) -> list[str]:
        """The words of a text in order; a special string is a word of its own."""
        if self.marks is None or not self.marks.search(text):
            return self._split(text)
        found: list[str] = []
        at = 0
        for mark in self.marks.finditer(text):
            found += self._split(text[at : mark.start()])
            found.append(mark[0])
            at = mark.end()
        return found + self._split(text[at:])

    def _split(self, text: str) -> list[str]:
        if not _OTHER.search(text):
            return self.plain.findall(text.lower())
        found: list[str] = []
        for part in text.split(" "):  # nothing composes with a space
            if _OTHER.search(part):
                found.extend(w for w, _ in self.exact.pre_tokenize_str(self.library.normalizer.normalize_str(part)))
            else:
                found.extend(self.plain.findall(part.lower()))
        return found

    def ids(self, word: str) -> list[int]:
        """Ids of one word."""
        if word in self.special:
            return [self.special[word]]
        return [t.id for t in self.library.model.tokenize("".join(self.signs[b] for b in word.encode()))]


def _offsets(texts: pa.LargeBinaryArray) -> np.ndarray:
    """Where each of ``texts`` starts in their bytes, and where the last one ends."""
    return np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)


def _spelled(signs: pa.LargeBinaryArray, ids: np.ndarray, starts: np.ndarray) -> pa.LargeBinaryArray:
    """The ids of each word, which lie between two ``starts``, as one text of their ``signs``."""
    taken = signs.take(pa.array(ids))
    offsets = np.ascontiguousarray(_offsets(taken)[starts])
    return pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(offsets), taken.buffers()[2] or pa.py_buffer(b"")])


def _starts(sizes) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(np.fromiter(sizes, np.int64))))


@lru_cache(maxsize=4)
def word_tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of a file, once per Python process."""
    return WordTokenizer(path)


def _texts(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def distinct_words(docs: DataFrame, path: str) -> DataFrame:
    """(word, n, ids): every distinct word of the texts, how often it occurs, and its ids, encoded once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = word_tokenizer(path), Counter()
        rows = lambda: pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.string()), "n": pa.array(seen.values(), pa.int64())})
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update(model.words(text))
                if len(seen) >= COUNTED:
                    yield rows()
                    seen.clear()
        yield rows()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = word_tokenizer(path)
        for batch in batches:
            ids = pa.array([model.ids(w) for w in batch.column("word").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict({"word": batch.column("word"), "n": batch.column("n"), "ids": ids})

    words = _texts(docs).select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return words.mapInArrow(encode, "word string, n long, ids array<int>")


def _frequent(table: DataFrame, held_bytes: int) -> list[tuple[str, list[int]]]:
    """The most frequent words, most frequent first, in ``held_bytes`` at most."""
    cost = F.lit(ENTRY_BYTES) + F.octet_length("word") * 2 + F.size("ids") * 12
    step = F.floor(F.log2("n") * STEPS).alias("step")
    sizes = table.groupBy(step).agg(F.sum(cost.cast("long")).alias("size")).collect()
    least, total = None, 0
    for step_, size in sorted(((r[0], r[1]) for r in sizes), reverse=True):
        total += size
        if total > held_bytes:
            break
        least = step_
    if least is None:
        return []
    rows = table.where(F.floor(F.log2("n") * STEPS) >= least).select("n", "word", "ids").collect()
    return [(r[1], list(r[2])) for r in sorted(rows, key=lambda r: (-r[0], r[1]))]


class _Numbers(dict):
    """Number of each broadcast word, -1 for all others."""

    def __missing__(self, word: str) -> int:
        return -1


def _lots(sizes: list[int]) -> Iterator[slice]:
    """Rows that follow each other, ``AT_ONCE`` words together unless a single row has more."""
    first, total = 0, 0
    for i, size in enumerate(sizes):
        if i > first and total + size > AT_ONCE:
            yield slice(first, i)
            first, total = i, 0
        total += size
    if sizes:
        yield slice(first, len(sizes))


class _Held:
    """The broadcast words by number, with their ids and pieces as texts, a space after each."""

    def __init__(self, model: WordTokenizer, words: list[tuple[str, list[int]]]):
        self.model = model
        self.number = _Numbers({w: i for i, (w, _) in enumerate(words)})
        starts, ids = _starts(len(ids) for _, ids in words), np.array([i for _, ids in words for i in ids], np.int32)
        self.ids, self.pieces = _spelled(model.digits, ids, starts), _spelled(model.pieces, ids, starts)
        self.many = np.diff(starts)

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, words), np.int32, len(words))

    def finish(self, rows: list[np.ndarray], own: np.ndarray, own_starts: np.ndarray) -> list[tuple[int, str, str]]:
        """Number of ids and digests of rows of numbers; ``own`` has the ids of the words that aren't held, in order."""
        gaps = [int(np.count_nonzero(row < 0)) for row in rows]
        if sum(gaps) != len(own_starts) - 1:
            raise ValueError("the words that aren't held don't fit the rows")
        results, at = [], 0
        for some in _lots(list(map(len, rows))):
            mine = own_starts[at : at + sum(gaps[some]) + 1]
            at += len(mine) - 1
            results += self._finish(rows[some], own[mine[0] : mine[-1]], mine - mine[0])
        return results

    def _finish(self, rows: list[np.ndarray], own: np.ndarray, own_starts: np.ndarray) -> list[tuple[int, str, str]]:
        numbers = np.concatenate(rows)
        borders = _starts(map(len, rows))
        numbers[numbers < 0] = np.arange(len(self.many), len(self.many) + len(own_starts) - 1)
        many = _starts(np.concatenate((self.many, np.diff(own_starts)))[numbers])[borders]
        digests = []
        for held, signs in ((self.ids, self.model.digits), (self.pieces, self.model.pieces)):
            texts = pa.concat_arrays([held, _spelled(signs, own, own_starts)]) if len(own) else held
            digests.append(_digests(texts.take(pa.array(numbers)), borders))
        return list(zip(np.diff(many).tolist(), *digests, strict=True))


_HELD: dict[str, _Held] = {}


def _held(path: str, shared) -> _Held:
    """The same for all tasks of a Python process; only the last table is kept."""
    if shared.id not in _HELD:
        _HELD.clear()
        _HELD[shared.id] = _Held(word_tokenizer(path), shared.value)
    return _HELD[shared.id]


class _Shared:
    """A broadcast value and a name for it."""

    def __init__(self, spark: SparkSession, value):
        self._broadcast = spark.sparkContext.broadcast(value)
        self.id = uuid.uuid4().hex

    @property
    def value(self):
        return self._broadcast.value


RESULT = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digests(texts: pa.LargeBinaryArray, borders: np.ndarray) -> list[str]:
    """Digest of the texts between two ``borders``, without the space after the last one."""
    raw, at = memoryview(texts.buffers()[2] or b""), _offsets(texts)[borders].tolist()
    return [hashlib.sha256(raw[a : max(a, b - 1)]).hexdigest() for a, b in zip(at, at[1:])]


def _pack(raw: bytes) -> bytes:
    return pa.Codec("zstd", compression_level=PACKING).compress(raw, asbytes=True)


def _packed_numbers(numbers: np.ndarray) -> bytes:
    return _pack(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _numbers(packed: bytes, many: int) -> np.ndarray:
    raw = pa.decompress(packed, 4 * many, codec="zstd", asbytes=True)
    return np.frombuffer(raw, np.uint8).reshape(4, -1).T.copy().view("<i4").ravel()


def encode_words(docs: DataFrame, path: str, held_bytes: int = HELD_BYTES) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of ``docs``; a null text counts as empty.

    Digests are those of the decimal ids joined by spaces, and of the decoded text. Rows are named by their place in
    ``docs``, which is read twice. Texts aren't shuffled: a row with words that aren't broadcast moves as numbers of
    words, with the words that have none.
    """
    spark = docs.sparkSession
    table = store(distinct_words(docs, path), "words")
    shared = _Shared(spark, _frequent(table, held_bytes))
    rows = _texts(docs).withColumn("row", F.monotonically_increasing_id())

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Finished rows; of the others the packed numbers of their words, and the words that have none."""
        model, held = word_tokenizer(path), _held(path, shared)
        for batch in batches:
            whole, done, packed, sizes, own, own_sizes = [], [], [], [], [], []
            for text in batch.column("text").to_pylist():
                words = model.words(text)
                at = held.numbers(words)
                done.append(not len(at) or int(at.min()) >= 0)
                if done[-1]:
                    whole.append(at)
                    for column in (packed, sizes, own, own_sizes):
                        column.append(None)
                    continue
                packed.append(_packed_numbers(at))
                sizes.append(len(at))
                mine = json.dumps([words[g] for g in np.flatnonzero(at < 0).tolist()], ensure_ascii=False).encode()
                own.append(_pack(mine))
                own_sizes.append(len(mine))
            found = iter(held.finish(whole, np.zeros(0, np.int32), np.zeros(1, np.int64)))
            results = [next(found) if d else (None, None, None) for d in done]
            yield pa.RecordBatch.from_pydict(
                {
                    "row": batch.column("row"),
                    "doc_id": batch.column("doc_id"),
                    "n_tokens": pa.array([r[0] for r in results], pa.int64()),
                    "ids_sha256": pa.array([r[1] for r in results], pa.string()),
                    "decoded_sha256": pa.array([r[2] for r in results], pa.string()),
                    "packed": pa.array(packed, pa.binary()),
                    "words": pa.array(sizes, pa.int32()),
                    "own": pa.array(own, pa.binary()),
                    "own_size": pa.array(own_sizes, pa.int64()),
                }
            )

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words that aren't held, with row and position."""
        for batch in batches:
            rows, at, word = [], [], []
            for row, packed, many, own, size in zip(*(batch.column(c).to_pylist() for c in ("row", "packed", "words", "own", "own_size")), strict=True):
                if packed is None:
                    continue
                at.append(np.flatnonzero(_numbers(packed, many) < 0))
                word += json.loads(pa.decompress(own, size, codec="zstd", asbytes=True))
                rows.append(np.full(len(at[-1]), row))
            row, at = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (rows, at))
            yield pa.RecordBatch.from_pydict({"row": pa.array(row, pa.int64()), "at": pa.array(at.astype(np.int32)), "word": pa.array(word, pa.string())})

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _held(path, shared)
        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in ("n_tokens", "ids_sha256", "decoded_sha256", "packed", "words")}
            waiting = [i for i, packed in enumerate(columns["packed"]) if packed is not None]
            rows = [_numbers(columns["packed"][i], columns["words"][i]) for i in waiting]
            found = batch.column("found").flatten()
            row, at = batch.column("found").value_parent_indices().to_numpy(), found.field("at").to_numpy()
            order = np.lexsort((at, row))
            gaps = [np.flatnonzero(numbers < 0) for numbers in rows]
            wanted = np.repeat(np.array(waiting, np.int64), [len(g) for g in gaps])
            if not np.array_equal(row[order], wanted) or not np.array_equal(at[order], np.concatenate([*gaps, np.zeros(0, np.int64)])):
                raise ValueError("the rows came in another order when they were read again; store the table first")
            ids = found.field("ids").take(pa.array(order))
            own_starts = _starts(ids.value_lengths().to_numpy())
            results = held.finish(rows, ids.flatten().to_numpy(), own_starts)
            for i, result in zip(waiting, results, strict=True):
                columns["n_tokens"][i], columns["ids_sha256"][i], columns["decoded_sha256"][i] = result
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_tokens": pa.array(columns["n_tokens"], pa.int64()),
                    "ids_sha256": pa.array(columns["ids_sha256"], pa.string()),
                    "decoded_sha256": pa.array(columns["decoded_sha256"], pa.string()),
                }
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    placed = rows.mapInArrow(places, f"row long, doc_id {kind}, {RESULT}, packed binary, words int, own binary, own_size long")
    dealt = placed.repartition("row")  # both branches take all of its columns, so that Spark runs it once
    back = dealt.mapInArrow(others, "row long, at int, word string").join(table.select("word", "ids"), "word")
    found = back.groupBy("row").agg(F.collect_list(F.struct("at", "ids")).alias("found"))  # words of one text
    return dealt.join(found, "row", "left").mapInArrow(finish, f"doc_id {kind}, {RESULT}")
