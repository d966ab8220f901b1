import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from flowlab.llm import jaccard_bayes as q
from flowlab.sources.tables import table

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text):
    w = WORD.findall(text or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows, threshold=0.8):
    """(doc_id, class_id, n_links) of each row; rows with an id and a shingle are compared."""
    sets = [shingles(t) for _, t in rows]
    holders = defaultdict(list)
    live = [i for i, (d, _) in enumerate(rows) if d is not None and sets[i]]
    for i in live:
        for s in sets[i]:
            holders[s].append(i)
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    links = Counter()
    for i in live:
        for j, n in Counter(j for s in sets[i] for j in holders[s] if j > i).items():
            if n >= threshold * (len(sets[i]) + len(sets[j]) - n):
                links[i] += 1
                links[j] += 1
                up[find(j)] = find(i)
    # Rows with one doc_id and one shingle set are one document of several rows.
    least = {}
    for i in live:
        least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return sorted(((d, least[find(i)] if i in set(live) else d, links[i]) for i, (d, _) in enumerate(rows)), key=repr)


def got(df):
    return sorted(((r.doc_id, r.class_id, r.n_links) for r in df.collect()), key=repr)


def test_odd_documents(docs, rows):
    assert got(q.join_similar(docs)) == brute([(r[0], r[1]) for r in rows])


def test_all_documents(spark, data):
    docs = table(spark, data, "documents")
    assert got(q.join_similar(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_a_large_group_over_several_blocks(spark):
    r = random.Random(1)
    base = [f"v{r.randrange(500)}" for _ in range(150)]
    rows = []
    for i in range(700):
        w = list(base)
        for _ in range(r.randrange(4)):
            w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(q.join_similar(df)) == brute(rows)


def test_keep_one(docs, rows):
    kept = q.keep_one(docs)
    assert kept.columns == docs.columns
    classes = brute([(r[0], r[1]) for r in rows])
    gone = {d for d, c, _ in classes if d is not None and c < d}
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[None] == 2
    assert {d: 1 for d, _, _ in classes if d is not None and d not in gone} == {d: n for d, n in ids.items() if d is not None}


def test_different_texts_of_one_id(spark):
    r = random.Random(7)
    texts = [" ".join(f"v{r.randrange(500)}" for _ in range(80)) for _ in range(12)]
    # Every text under id 1, near copies of each under ids of their own, one of them under a smaller id.
    rows = [(1, t) for t in texts] + [(10 + i, t + " end") for i, t in enumerate(texts)] + [(0, "start " + texts[4]), (1, texts[2])]
    rows += [(30, texts[7]), (30, "only here are these few words"), (31, ""), (31, None)]
    expected = brute(rows)
    assert sum(n > 0 for _, _, n in expected) == len(rows) - 3
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        assert got(q.join_similar(df)) == expected
        kept = sorted((d, t or "") for d, t in q.keep_one(df, per_id=False).collect())
        first = [(1, t) for i, t in enumerate(texts) if i != 4]
        assert kept == sorted([*first, (0, "start " + texts[4]), (30, "only here are these few words"), (31, "")])


def test_no_documents(no_docs):
    assert q.join_similar(no_docs).count() == 0
    assert q.keep_one(no_docs).count() == 0


def test_posterior_against_integration():
    x = (np.arange(200_000) + 0.5) / 200_000
    for m, n in [(0, 16), (10, 16), (16, 16), (60, 96), (90, 96)]:
        density = x**m * (1 - x) ** (n - m)
        assert q.posterior(m, n) == pytest.approx(density[x >= 0.8].sum() / density.sum(), rel=1e-3, abs=1e-12)
    least = q.least_matches()
    assert least == sorted(least) and q.posterior(least[-1] - 1, q.HASHES) < q.TOLERANCE
