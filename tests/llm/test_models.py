"""Learned operators: held-out accuracy, and their parts against enumeration."""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa

from riskweave.llm import language_codes, line_quality
from riskweave.llm.common import flat_bytes
from tests.llm.frames import EDGES, documents, table


def test_codewords_differ_in_many_bits():
    for count in (2, 3, 4, 7, 20, 60):
        code = language_codes.codewords(count)
        apart = min(int((code[i] != code[j]).sum()) for i in range(count) for j in range(i))
        assert apart >= max(1, code.shape[1] // 4)


def test_a_wrong_bit_is_corrected():
    model = language_codes.LanguageModel(list("abcd"), language_codes.codewords(4), np.zeros((1, 7)))
    for k in range(4):
        for bit in range(7):
            margins = 3.0 * model.codes[k].copy()
            margins[bit] *= -1
            best, _, _ = language_codes.decode(model, margins[None])
            assert best[0] == k


def test_languages_of_held_out_documents(spark):
    docs = table(spark, "sf0.01", "documents")
    found = language_codes.label(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(found) > 200
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.98
    assert all(0 <= r.score <= 1 for r in found)


def test_languages_of_odd_documents(spark):
    docs = documents(spark, clashing=True)
    found = language_codes.label(docs).collect()
    assert len(found) == len(EDGES)
    by_id = {r.doc_id: r for r in found}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (2, 3, 4, 6, 11))
    assert by_id[7].lang_pred != "und"
    kept = language_codes.keep_identified(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()}.isdisjoint({2, 3, 4, 6, 11})
    assert language_codes.label(documents(spark, [])).count() == 0
    # Nothing to learn from: every text is undecided.
    assert {r.lang_pred for r in language_codes.label(documents(spark, [(1, "a b", None, "s", 3)])).collect()} == {"und"}


def test_copies_take_one_place_of_the_sample(spark):
    """Whichever text it is that has the copies."""
    texts = [f"text number {i}" for i in range(40)]
    rows = [(1000 * i + k, t, "en", "s", 0) for i, t in enumerate(texts) for k in range(30)]
    found = language_codes.sample(documents(spark, rows), 25)
    assert len(found) == len(set(found)) == 25


def test_marginals_against_enumeration():
    draw = np.random.default_rng(1)
    per = np.array([3, 0, 1, 5, 2])
    good, pairs = draw.normal(size=per.sum()), draw.normal(size=(2, 2))
    found, both = line_quality.marginals(good, pairs, per)
    at, seen = 0, np.zeros((2, 2))
    for n in per:
        weights, counts, total = np.zeros(n), np.zeros((2, 2)), 0.0
        for states in product((0, 1), repeat=int(n)) if n else ():
            steps = list(zip(states, states[1:], strict=False))
            weight = np.exp(sum(good[at + k] for k, s in enumerate(states) if s) + sum(pairs[s] for s in steps))
            total += weight
            weights += weight * np.array(states)
            for s in steps:
                counts[s] += weight
        if n:
            assert np.allclose(found[at : at + n], weights / total)
            seen += counts / total
        at += n
    assert np.allclose(both, seen)


def test_features_belong_to_their_text():
    texts = ["one line\ntwo lines here\n\n!!! ###", "", "\n \n", "word word word word", "Ünïcode ßtraße\nlast"]
    together = line_quality.line_features(*flat_bytes(pa.array(texts)))
    assert together[2].tolist() == [3, 0, 0, 1, 2]
    at = 0
    for text, n in zip(texts, together[2], strict=True):
        alone = line_quality.line_features(*flat_bytes(pa.array([text])))
        assert np.allclose(together[0][at : at + n], alone[0]) and together[1][at : at + n].tolist() == alone[1].tolist()
        at += n


def test_quality_of_held_out_documents(spark):
    docs, labels = table(spark, "sf0.1", "documents"), table(spark, "sf0.1", "labels")
    found = line_quality.document_quality(docs, labels)
    assert found.count() == docs.count()
    rows = found.where("held_out").join(labels.select("doc_id", "quality"), "doc_id").select("score", "predicted", "quality").collect()
    score, quality = np.array([r.score for r in rows]), np.array([r.quality for r in rows])
    rank = np.argsort(np.argsort(score))
    good = quality == 1
    area = (rank[good].sum() - good.sum() * (good.sum() - 1) / 2) / (good.sum() * (~good).sum())
    assert area > 0.97 and np.mean([r.predicted == r.quality for r in rows]) > 0.95


def test_quality_of_odd_documents(spark):
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, 0), (6, 0, 0), (8, 0, 1), (9, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    found = line_quality.document_quality(documents(spark, clashing=True), labels).collect()
    assert len(found) == len(EDGES) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    assert line_quality.document_quality(documents(spark, []), labels).count() == 0
    assert line_quality.document_quality(documents(spark), labels.limit(0)).count() == len(EDGES)


def test_a_repeated_id_is_one_row_of_the_sample(spark, monkeypatch):
    """However many rows and texts it has, only one of them reaches the driver."""
    reached = []
    monkeypatch.setattr(line_quality, "fit", lambda features, size, per, label: reached.append((len(per), label.tolist())))
    rows = [(1, f"text {i % 50}", "en", "s", 0) for i in range(300)] + [(7, "another text", "en", "s", 0)]
    labels = spark.createDataFrame([(1, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")
    docs = documents(spark, rows)
    for some in (docs, docs.repartition(3)):
        line_quality.train(some, labels)
    assert reached == [(2, [1, 0])] * 2


def test_labels_that_clash_give_one_result_in_any_order(spark, monkeypatch):
    ids = (0, 1, 10, 11, 12)  # none of them is held out
    docs = documents(spark, [(k, f"text number {k}", "en", "a", 1) for k in ids])
    rows = [(k, label) for k in ids for label in (k % 2, 1, k % 2)]
    learned: list = []
    monkeypatch.setattr(line_quality, "fit", lambda features, size, per, label: learned.append(label.tolist()))
    for order in (rows, rows[::-1], sorted(rows, key=lambda r: r[1])):
        line_quality.train(docs, spark.createDataFrame(order, "doc_id long, quality int").repartition(3))
    assert learned == [[k % 2 for k in ids]] * 3
