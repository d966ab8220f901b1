import itertools
import re

import numpy as np
import pytest

from flowlab.llm import quality_crf as q
from flowlab.sources.tables import table

WORD = re.compile("[^\x20\x09-\x0d]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = {w: windows.count(w) for w in set(windows)} if len(windows) < 2000 else None
    if seen is None:
        seen = {}
        for w in windows:
            seen[w] = seen.get(w, 0) + 1
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(8)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    n = len(words)
    symbols = sum(c in "#*$%&|<>" for c in text)
    failed = n < 20 or 100 * len(covered) > 30 * n
    return n, sum(map(len, words)), symbols, dup, len(covered), failed


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_base_counts_of_odd_texts(docs, rows):
    got = sorted((tuple(r[c] for c in ["doc_id", *COLUMNS]) for r in q.rate(docs, q.ALL_CONTENT).collect()), key=repr)
    assert got == sorted(((r[0], *base(r[1])) for r in rows), key=repr)


def test_base_counts_of_all_documents(spark, data):
    docs = table(spark, data, "documents")
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in q.rate(docs, q.ALL_CONTENT).collect()}
    assert got == {r.doc_id: base(r.text) for r in docs.collect()}


def test_repeats_and_lines(spark):
    eight = "a b c d e f g h"
    texts = [f"{eight} {eight}", "x\nx\n x\n\n\nx", f"{eight}\n{eight} {eight}", "\n".join(["r s"] * 30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: tuple(r[c] for c in COLUMNS) for r in q.rate(df, q.ALL_CONTENT).collect()} == {i: base(t) for i, t in enumerate(texts)}


def test_viterbi_is_the_best_of_all_sequences():
    random = np.random.default_rng(1)
    for n in range(1, 9):
        scores, move = random.normal(size=n), random.normal(size=(2, 2))

        def total(labels, scores=scores, move=move):
            return sum(s for s, y in zip(scores, labels, strict=True) if y) + sum(move[x, y] for x, y in itertools.pairwise(labels))

        best = max(map(total, itertools.product((0, 1), repeat=n)))
        assert total(q.viterbi(scores.tolist(), move.tolist())) == pytest.approx(best)


def test_held_out_documents_are_judged_right(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = q.fit(docs, labels.where("doc_id % 2 = 0"))
    judged = q.rate(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").collect()
    right = sum(r.kept == (r.quality == 1) for r in judged)
    assert right >= 0.97 * len(judged) > 0


def test_keep_agrees_with_rate_and_keeps_columns(docs):
    model = q.LineModel(np.random.default_rng(2).normal(size=len(q.FEATURES)))
    kept = q.keep(docs, model)
    assert kept.columns == docs.columns
    expected = sorted(repr(r.doc_id) for r in q.rate(docs, model).where("kept").collect())
    assert sorted(repr(r.doc_id) for r in kept.collect()) == expected


def test_empty_table_and_no_labels(spark, no_docs, docs):
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 0), (2, 1)], "doc_id long, quality int")
    assert q.fit(docs, labels) is q.ALL_CONTENT
    assert q.rate(no_docs, q.ALL_CONTENT).count() == 0
    assert q.content_text(docs.where("doc_id = 1"), q.ALL_CONTENT).first().text == docs.where("doc_id = 1").first().text
