import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowlab.llm import line_marginals as q
from flowlab.llm.text import text_slices
from flowlab.sources.tables import table


def odds_by_enumeration(scores, move):
    """The probability of good of every line, over all label sequences."""
    n = len(scores)
    total, good = 0.0, np.zeros(n)
    for labels in itertools.product((0, 1), repeat=n):
        weight = np.exp(sum(s for s, y in zip(scores, labels, strict=True) if y) + sum(move[a, b] for a, b in itertools.pairwise(labels)))
        total += weight
        good += weight * np.array(labels)
    return good / total


def test_marginals_equal_enumeration():
    random = np.random.default_rng(4)
    model = q.ChainModel(random.normal(size=(q.WIDTH, 3)), random.normal(size=(2, 2)))
    sizes = [1, 5, 0, 8, 2]
    at = np.concatenate([[0], np.cumsum(sizes)])
    lines = random.random((at[-1], q.WIDTH))
    got = q.marginals(lines, at, model)
    for a, b in itertools.pairwise(at.tolist()):
        own = lines[a:b]
        scores = own @ model.emit[:, 0]
        scores[1:] += own[:-1] @ model.emit[:, 1]
        scores[:-1] += own[1:] @ model.emit[:, 2]
        if b > a:
            assert got[a:b] == pytest.approx(odds_by_enumeration(scores, model.move))


def log_likelihood(flat, lines, at, truth, weight):
    model = q.ChainModel.of(flat)
    scores, total = q.line_scores(lines, at, model.emit), 0.0
    for a, b in itertools.pairwise(at.tolist()):
        rated = []
        for labels in itertools.product((0, 1), repeat=b - a):
            rated.append(scores[a:b] @ np.array(labels) + sum(model.move[x, y] for x, y in itertools.pairwise(labels)))
        seen = scores[a:b] @ truth[a:b] + sum(model.move[int(x), int(y)] for x, y in itertools.pairwise(truth[a:b]))
        total += weight[a] * (seen - np.logaddexp.reduce(rated))
    return total


def test_gradient_equals_finite_differences():
    random = np.random.default_rng(5)
    at = np.array([0, 4, 5, 11])
    lines, truth = random.random((11, q.WIDTH)), random.integers(0, 2, 11).astype(float)
    weight = np.repeat([0.7, 1.3, 2.0], np.diff(at))
    flat = random.normal(size=3 * q.WIDTH + 4) * 0.5
    got = q.gradient(flat, lines, at, truth, weight)
    for k in [0, 1, 2, 17, 40, 3 * q.WIDTH - 1, *range(3 * q.WIDTH, 3 * q.WIDTH + 4)]:
        step = np.zeros_like(flat)
        step[k] = 1e-5
        slope = (log_likelihood(flat + step, lines, at, truth, weight) - log_likelihood(flat - step, lines, at, truth, weight)) / 2e-5
        assert got[k] == pytest.approx(slope, abs=1e-5)


def features(text):
    part = next(iter(text_slices([pa.RecordBatch.from_arrays([pa.array(["before me", text, "after"])], ["text"])], limit=1 << 30)))
    lines, length, at = q.line_features(part)
    mine = slice(at[1], at[2])
    return [dict(zip(q.FEATURES, row, strict=True)) for row in lines[mine] / 255.0], length[mine].tolist()


def test_features_of_lines():
    rows, length = features("One two three.\n\none ONE one one\nOne two three.\nend")
    assert length == [12, 0, 12, 12, 3]
    assert [r["no_word"] for r in rows] == [0, 1, 0, 0, 0]
    assert [r["repeated_line"] for r in rows] == [0, 0, 0, 1, 0]
    assert [r["ends_sentence"] for r in rows] == [1, 0, 0, 1, 0]
    assert rows[2]["same_as_last"] == pytest.approx(0.25, abs=0.01)
    assert features("")[1] == [0] and features("\n")[1] == [0, 0]


def test_very_long_texts_keep_their_lines():
    text = "\n".join(["a good line of words, really."] * 30_000 + ["x" * 300_000])
    rows, length = features(text)
    assert len(rows) == 30_001 and length[-1] == 300_000


def scored(docs, labels):
    return {(r.doc_id, i): r for i, r in enumerate(q.classify(docs, labels).orderBy("doc_id", "score").collect())}


def test_odd_documents(spark, docs, rows):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 0), (3, 1), (None, 1), (7, None)], "doc_id long, quality int")
    labels = labels.withColumn("lines", F.lit("clash"))
    out = q.classify(docs, labels).collect()
    assert sorted(repr(r.doc_id) for r in out) == sorted(repr(r[0]) for r in rows)
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    texts = {r[0]: r[1] for r in rows if r[0] is not None and r[0] != 5}
    assert all(r.good_share == 0 for r in out if r.doc_id in texts and not (texts[r.doc_id] or "").split())


def test_labels_of_one_kind_and_empty_tables(spark, docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert all(r.good_share > 0.99 for r in q.classify(docs, labels).where("doc_id < 40").collect())
    assert q.classify(no_docs, labels).collect() == []


def test_held_out_labels_are_never_read(spark, data):
    docs, labels = table(spark, data, "documents"), table(spark, data, "labels")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    lines = q.materialise(q.sketch(docs), "lines")
    a, b = q.fit(lines, labels), q.fit(lines, turned)
    assert np.allclose(a.flat(), b.flat()) and a.slope == b.slope


def test_held_out_documents_are_judged_right(spark, data):
    folder = data.replace("sf0.001", "sf0.01")
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    judged = q.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.quality for r in judged)
    assert right >= 0.95 * len(judged) > 0
