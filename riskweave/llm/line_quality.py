"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. The field scores a line's state by features of the line and of its neighbours,
and pairs of adjacent states by a table; forward and backward sums give each line's probability to be good.
A document's quality is the mean of these, weighted by the lines' lengths, and calibrated on the
training documents. Labels belong to documents: in training each line takes its document's label.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import flat_bytes, held_out, map_column, sums

#: Training sample: labelled documents, and bytes of one; longer documents teach nothing.
SAMPLE, LONGEST = 3000, 30_000
STEPS, RATE, PENALTY = 250, 0.1, 1e-4

_OWN = 19
FEATURES = _OWN * 3 + 2


def _classes() -> np.ndarray:
    """Kinds of bytes: letter, upper case, digit, white space, sentence mark, call mark, other sign, beyond ASCII."""
    kinds = np.zeros((256, 8), dtype=np.float32)
    for b in range(256):
        c = chr(b)
        kinds[b] = [
            b < 128 and c.isalpha(), b < 128 and c.isupper(), b < 128 and c.isdigit(), c in " \t\r\f\v",
            c in ".,;:'\"()-", c in "!?", b < 128 and 32 < b and not c.isalnum() and c not in ".,;:'\"()-!?", b >= 128,
        ]
    return kinds


_KINDS = _classes()
_SEED = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWERS = np.random.default_rng(6).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_PIECE = 1 << 20


def _spans(raw: np.ndarray, starts: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of positions that are ``inside``, as starts and ends; a row ends where a text ends."""
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[starts] = True
    begins = inside & (edge[:-1] | ~np.concatenate(([False], inside[:-1])))
    ends = inside & (edge[1:] | ~np.concatenate((inside[1:], [False])))
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def line_features(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line that isn't blank, its number of bytes, and how many such lines each text has."""
    low, high = _spans(raw, starts, raw != 10)
    solid = sums(~np.isin(raw, (32, 9, 11, 12, 13)), _interleaved(low, high))[::2] > 0 if len(low) else np.zeros(0, bool)
    low, high = low[solid], high[solid]
    of = np.searchsorted(starts, low, side="right") - 1
    per = np.bincount(of, minlength=len(starts) - 1)
    size = high - low
    if not len(low):
        return np.zeros((0, FEATURES), np.float32), size, per
    share = np.zeros((len(low), 8))
    for at in range(0, len(raw), _PIECE):  # the table of kinds is laid out for one piece at a time
        part = _KINDS[raw[at : at + _PIECE]]
        share += sums(part, np.clip(_interleaved(low, high) - at, 0, len(part)))[::2]
    share /= size[:, None]
    first, last = _spans(raw, starts, ~np.isin(raw, (32, 9, 10, 11, 12, 13)))
    length = last - first
    marks = _SEED[raw] * _POWERS[_within(raw, first) & 63]
    marks = np.concatenate(([np.uint64(0)], np.cumsum(marks, dtype=np.uint64)))
    word = marks[last] - marks[first]
    same = np.zeros(len(word), dtype=np.float64)
    same[1:] = word[1:] == word[:-1]
    line = np.searchsorted(low, first, side="right") - 1
    words = np.bincount(line, minlength=len(low)).astype(np.float64)
    repeated = np.bincount(line, same, minlength=len(low)) / np.maximum(words, 1)
    width = np.bincount(line, length, minlength=len(low)) / np.maximum(words, 1)
    print_ = marks[high] - marks[low]
    _, group, times = np.unique(np.stack([print_, of.astype(np.uint64)]), axis=1, return_inverse=True, return_counts=True)
    twice = (times[group.ravel()] > 1).astype(np.float64)
    own = np.column_stack(
        [
            np.ones(len(low)),
            share,
            np.log1p(size) / 5,
            np.log1p(words) / 3,
            width / 10,
            repeated,
            twice,
            np.isin(raw[high - 1], (33, 46, 63)),
            share[:, 1] > 0.3,
            share[:, 5] > 0.05,
            share[:, 6] > 0.05,
            repeated > 0.2,
        ]
    )
    before, after = np.zeros_like(own), np.zeros_like(own)
    joined = of[1:] == of[:-1]
    before[1:][joined] = own[:-1][joined]
    after[:-1][joined] = own[1:][joined]
    edges = np.column_stack([np.concatenate(([True], ~joined)), np.concatenate((~joined, [True]))])
    return np.hstack([own, before, after, edges]).astype(np.float32), size, per


def _within(raw: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Distance of each position to the last word start at or before it."""
    at = np.zeros(len(raw), dtype=np.int64)
    at[first] = first
    return np.arange(len(raw)) - np.maximum.accumulate(at)


def _interleaved(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.column_stack([low, high]).ravel()


@dataclass
class LineModel:
    """``weights`` score the good state against the bad one; ``pairs`` scores [before][after]; ``scale`` calibrates."""

    weights: np.ndarray
    pairs: np.ndarray
    scale: tuple[float, float]


def _layout(per: np.ndarray) -> list[np.ndarray]:
    """For each position of a line in its text: the lines there, texts with the most lines first."""
    order = np.argsort(-per, kind="stable")
    begin = np.concatenate(([0], np.cumsum(per)[:-1]))[order]
    alive = np.searchsorted(-per[order], -np.arange(per.max(initial=0)), side="left")
    return [begin[:n] + k for k, n in enumerate(alive)]


def marginals(good: np.ndarray, pairs: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of the good state per line, and the expected number of each pair of adjacent states."""
    score = np.column_stack([np.zeros(len(good)), good]).astype(np.float64)
    steps = _layout(per)
    ahead, back = np.zeros((len(good), 2)), np.zeros((len(good), 2))
    both = np.zeros((2, 2))
    for k, rows in enumerate(steps):
        came = np.logaddexp.reduce(ahead[steps[k - 1][: len(rows)]][:, :, None] + pairs[None], axis=1) if k else 0.0
        ahead[rows] = came + score[rows]
    for k in range(len(steps) - 2, -1, -1):
        after = steps[k + 1]
        here = steps[k][: len(after)]
        to = pairs[None] + (score[after] + back[after])[:, None, :]
        back[here] = np.logaddexp.reduce(to, axis=2)
        joint = ahead[here][:, :, None] + to
        both += np.exp(joint - np.logaddexp.reduce(joint, axis=(1, 2), keepdims=True)).sum(axis=0)
    total = ahead + back
    return np.exp(total[:, 1] - np.logaddexp(total[:, 0], total[:, 1])), both


def mean_good(good: np.ndarray, size: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Means per text, weighted by length; one half for a text without lines."""
    of = np.repeat(np.arange(len(per)), per)
    weight = np.bincount(of, size, minlength=len(per))
    return np.where(weight > 0, np.bincount(of, good * size, minlength=len(per)) / np.maximum(weight, 1), 0.5)


def _log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit(features: np.ndarray, size: np.ndarray, per: np.ndarray, label: np.ndarray) -> LineModel:
    """Ascend the likelihood of the labelled lines; the two labels and all documents weigh alike."""
    of = np.repeat(np.arange(len(per)), per)
    state = label[of].astype(np.float64)
    weights, pairs = np.zeros(features.shape[1]), np.zeros((2, 2))
    if not len(per) or len(set(label.tolist())) < 2:
        sure = 4.0 * (float(label.mean()) - 0.5) if len(label) else 0.0
        return LineModel(weights, pairs, (0.0, sure))
    adjacent = of[1:] == of[:-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (state[:-1][adjacent].astype(int), state[1:][adjacent].astype(int)), 1)
    step = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(pairs), np.zeros_like(pairs)]
    for turn in range(1, STEPS + 1):  # Adam
        good, both = marginals(features @ weights, pairs, per)
        for k, (value, slope) in enumerate(((weights, features.T @ (state - good)), (pairs, seen - both))):
            slope = slope / len(of) - PENALTY * value
            step[2 * k] = 0.9 * step[2 * k] + 0.1 * slope
            step[2 * k + 1] = 0.999 * step[2 * k + 1] + 0.001 * slope**2
            value += RATE * step[2 * k] / (1 - 0.9**turn) / (np.sqrt(step[2 * k + 1] / (1 - 0.999**turn)) + 1e-8)
    good, _ = marginals(features @ weights, pairs, per)
    odds, (a, b) = _log_odds(mean_good(good, size, per)), (1.0, 0.0)
    for _ in range(500):  # calibration: a logistic curve over the log odds
        p = 1 / (1 + np.exp(-(a * odds + b)))
        a, b = a + 0.1 * float(((label - p) * odds).mean() - 1e-3 * (a - 1)), b + 0.3 * float((label - p).mean())
    return LineModel(weights, pairs, (max(a, 0.0), b))


def score(model: LineModel, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Quality of each text."""
    features, size, per = line_features(raw, starts)
    good, _ = marginals(features @ model.weights, model.pairs, per)
    a, b = model.scale
    return 1 / (1 + np.exp(-(a * _log_odds(mean_good(good, size, per)) + b)))


def train(docs: DataFrame, labels: DataFrame) -> LineModel:
    """Learn from a bounded sample of the labelled documents that aren't held out, chosen by a hash of their id.

    An id with several labels has the lowest of them.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(SAMPLE)
    text = docs.where(F.octet_length("text").between(1, LONGEST)).select("doc_id", "text")
    # An id that repeats stands for one row: that of the smallest hash of its text.
    known = text.join(F.broadcast(chosen), "doc_id").withColumn("_draw", F.xxhash64("text"))
    least = known.groupBy("doc_id").agg(F.min("_draw").alias("_draw"))
    rows = known.join(F.broadcast(least), ["doc_id", "_draw"]).select("doc_id", "text", "quality").distinct().collect()  # SAMPLE rows
    rows.sort(key=lambda r: (r[0], r[1]))
    raw, starts = flat_bytes(pa.array([r[1] for r in rows], pa.large_string()))
    return fit(*line_features(raw, starts), np.array([int(r[2]) for r in rows]))


def document_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every text; a null text counts as empty. One pass after training."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def rows(texts: pa.Array) -> dict[str, pa.Array]:
        return {"score": pa.array(score(shared.value, *flat_bytes(texts)))}

    found = map_column(docs, rows, "score double")
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
