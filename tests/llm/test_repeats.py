"""Seed and extend, and suffix sorting, against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from flowlab.llm import anchors, seed_extend, suffix_dcx
from flowlab.sources.tables import table

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_bytes(rows, window=200):
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(hash(b[k : k + window]) for _, b in texts for k in range(len(b) - window + 1))
    out = Counter()
    for d, b in texts:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - window + 1):
            if seen[hash(b[k : k + window])] > 1:
                gone[k : k + window] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[d, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()] += 1
    return out


def brute_words(rows, window=50):
    texts = [(d, WORD.findall(t or "")) for d, t in rows]
    first = {}
    for d, w in texts:
        if d is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, d), d)
    out = Counter()
    for d, w in texts:
        gone = [False] * len(w)
        if d is not None:
            for k in range(len(w) - window + 1):
                if first[tuple(w[k : k + window])] < d:
                    gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("hot", [5000, 1])
def test_odd_documents(docs, rows, hot):
    pairs = [(r[0], r[1]) for r in rows]
    assert Counter(map(tuple, suffix_dcx.repeats(docs, hot=hot).collect())) == brute_bytes(pairs)
    assert Counter(tuple(r)[:4] for r in seed_extend.repeats(docs, hot=hot).collect()) == brute_words(pairs)


def test_all_documents(spark, data):
    docs = table(spark, data, "documents")
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    assert Counter(map(tuple, suffix_dcx.repeats(docs).collect())) == brute_bytes(pairs)
    assert Counter(tuple(r)[:4] for r in seed_extend.repeats(docs).collect()) == brute_words(pairs)


@pytest.mark.parametrize("hot", [5000, 20])
def test_a_passage_in_many_documents(spark, hot):
    r = random.Random(2)
    common = " ".join(f"c{r.randrange(50)}" for _ in range(90))
    rows = []
    for i in range(120):
        before, after = (" ".join(f"d{r.randrange(3)}" for _ in range(r.randrange(60))) for _ in range(2))
        cut = common[: r.randrange(150, len(common))] if i % 4 == 0 else common
        rows.append((i, f"{before} {cut} {after}"))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert Counter(map(tuple, suffix_dcx.repeats(df, hot=hot).collect())) == brute_bytes(rows)
    assert Counter(tuple(r)[:4] for r in seed_extend.repeats(df, hot=hot).collect()) == brute_words(rows)


def test_strip(docs, rows):
    kept = suffix_dcx.strip(docs)
    assert kept.columns == docs.columns
    pairs = [(r[0], r[1]) for r in rows]
    expected = {(d, size - gone) for d, size, gone, _, _ in brute_bytes(pairs) if gone < size or size == 0}
    got = {(r.doc_id, len((r.text or "").encode())) for r in kept.where("text is null or text not like '%é%'").collect()}
    assert got <= expected and len(kept.collect()) == sum(n for (d, size, gone, _, _), n in brute_bytes(pairs).items() if gone < size or size == 0)
    assert all(r.n_chars == len(r.text) for r in kept.where("n_chars is not null").collect())


def test_no_documents(no_docs):
    assert suffix_dcx.repeats(no_docs).count() == 0
    assert suffix_dcx.strip(no_docs).count() == 0
    assert seed_extend.repeats(no_docs).count() == 0


def test_maximal_repeats_and_text(spark):
    shared = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, f"a b {shared}"), (2, f"{shared} c"), (3, f"x {shared} y")], "doc_id long, text string")
    got = {r.doc_id: (r.repeats, r.kept) for r in seed_extend.repeats(df, with_text=True).collect()}
    assert got == {1: ("", None), 2: ("0:60", "c"), 3: ("1:61", "x y")}


def test_suffix_order():
    r = random.Random(4)
    for n in [*range(40), 100, 500]:
        for size in (1, 2, 5, 300, 1 << 22):
            values = np.array([r.randrange(size) for _ in range(n)], np.int64)
            assert suffix_dcx.suffix_order(values).tolist() == sorted(range(n), key=lambda i: values[i:].tolist())


def test_anchors_of_a_text_longer_than_a_place_holds(monkeypatch):
    values = np.random.default_rng(3).integers(0, 2**63, 1000, dtype=np.uint64) << np.uint64(1)
    values[::7] = values[0]
    expected = anchors.smallest_in(values, 20)
    monkeypatch.setattr(anchors, "_PLACE", 8)
    for n in (255, 256, 257, 492, 493, 1000):
        assert (anchors.smallest_in(values[:n], 20) == expected[: n - 19]).all()


def test_chunk_without_repeats():
    """No window flagged, or no rows at all: an empty batch of the same columns."""
    owners = [np.zeros(2, anchors.OWNER).tobytes()]
    for flags, cuts in ((np.zeros(3, bool), np.array([0, 3])), (np.zeros(0, bool), np.array([0, 0]))):
        out = anchors.flagged_spans(flags, cuts, owners, 50)
        assert out.schema.names == ["a", "b", "spans"] and out.num_rows == 0
