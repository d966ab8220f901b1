import zlib

import numpy as np
import pytest

from flowlab.llm import weak_labels as q
from flowlab.sources.tables import table


@pytest.fixture(scope="module")
def fitted(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return docs, labels, q.fit(docs, labels)


def test_held_out_accuracy(fitted):
    docs, labels, (_, _, classifier) = fitted
    rows = q.score(docs, classifier).join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.toxic for r in rows)
    found = sum(r.predicted for r in rows if r.toxic)
    assert right >= 0.98 * len(rows)
    assert found >= 0.85 * sum(r.toxic for r in rows) > 0


def test_columns_and_fold(fitted, docs, rows):
    _, _, (_, _, classifier) = fitted
    got = q.score(docs, classifier).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_labels_of_held_out_rows_do_not_matter(fitted, spark):
    docs, labels, (voters, _, classifier) = fitted
    flipped = labels.withColumn("toxic", q.F.when(q.held_out(), 1 - q.F.col("toxic")).otherwise(q.F.col("toxic")))
    again, _, other = q.fit(docs, flipped)
    assert again == voters and other.weights == classifier.weights and other.bias == classifier.bias


def test_label_model_finds_accuracies_and_correlation():
    random = np.random.default_rng(3)
    n = 40_000
    y = random.random(n) < 0.2
    fire = np.stack([np.where(y, random.random(n) < p, random.random(n) < q_) for p, q_ in [(0.9, 0.05), (0.7, 0.02), (0.6, 0.1), (0.8, 0.03)]], 1)
    fire = np.concatenate([fire, fire[:, :1] ^ (random.random((n, 1)) < 0.02)], 1)  # follows voter 0
    patterns, counts = np.unique(fire @ (1 << np.arange(5)), return_counts=True)
    firing = sum((patterns >> k) & 1 for k in range(5))
    model = q.LabelModel(patterns, counts, 5, np.array([0.02, 0.4, 0.8, 0.9, 0.95, 0.99])[firing])
    assert abs(model.prior - 0.2) < 0.03
    assert np.abs(model.accuracy[1, :4] - [0.9, 0.7, 0.6, 0.8]).max() < 0.06
    assert np.abs(model.accuracy[0, :4] - [0.05, 0.02, 0.1, 0.03]).max() < 0.03
    assert model.parent[4] == 0 or model.parent[0] == 4
    posterior = dict(zip(patterns.tolist(), model.posterior(patterns).tolist(), strict=True))
    guess = np.array([posterior[p] > 0.5 for p in (fire @ (1 << np.arange(5))).tolist()])
    assert (guess == y).mean() > 0.95


def test_no_labels_no_rows(spark, docs, no_docs, rows):
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 0), (2, 1)], "doc_id long, toxic int")
    voters, _, classifier = q.fit(docs, labels)
    assert not any(voters.lists)
    assert {r.predicted for r in q.score(docs, classifier).collect()} == {0}
    _, model, classifier = q.fit(no_docs, labels)
    assert model is None and q.score(no_docs, classifier).count() == 0
