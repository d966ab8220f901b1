import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import zstandard

from flowlab.llm import collocations as q
from flowlab.llm.text import text_slices

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
        yield [w for w in re.split("[ \t]", piece) if w]


def brute(rows, least=10, first=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            n[lang] += len(words)
            for size in (1, 2, 3):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i : i + size])] += 1
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, w), a in candidates.items():
        inside = [b for (other, x), b in candidates.items() if other == lang and len(x) > len(w) and (x[:2] == w or x[1:] == w)]
        if any(100 * b >= 50 * a for b in inside):
            continue
        cuts = [(10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted(
        (lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:first])
    )


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_odd_documents(docs, rows):
    for least, first in ((2, 2000), (10, 5)):
        assert got(q.collocations(docs, least=least, first=first)) == brute([(r[1], r[2]) for r in rows], least, first)


def made_rows():
    r = random.Random(2)
    vocabulary = [f"W{i}" for i in range(6)] + ["é", "the", " x", "ÀB"]
    texts = []
    for _ in range(400):
        texts.append("".join(r.choice(vocabulary) + r.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\r\n", "\x0b", "!? "]) for _ in range(r.randrange(60))))
    return [(t, r.choice(["en", "fr", None, "und", ""])) for t in texts] + [("hot pair again " * 3000, "en"), (None, None), ("", "en"), (" .,", "xx")]


def test_made_documents_and_sql(spark):
    rows = made_rows()
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string").repartition(7)
    expected = brute(rows)
    assert len(expected) > 60
    assert got(q.collocations(df)) == expected
    con = duckdb.connect()
    con.register("documents", pa.table({"text": [t for t, _ in rows], "lang": [x for _, x in rows]}))
    assert sorted(con.execute(q.SQL).fetchall()) == expected


def test_bursts_spills_and_new_ids_change_no_count(monkeypatch):
    """Containers of 50 phrases, spills at 500, new word ids at 20: runs of many prefix partitions, merged in small steps."""
    for name, value in (("BURST", 50), ("HELD", 500), ("WORDS", 20)):
        monkeypatch.setattr(q, name, value)
    monkeypatch.setattr(q.Merger, "WAITING", 64)
    rows = [(t, lang or "und") for t, lang in made_rows()]
    batch = pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows]), pa.array([x for _, x in rows])], ["text", "lang"])
    counter, runs = q.Counter(5), []
    for part in text_slices([batch], limit=1000):
        runs += counter.add(part, part.rows.column("lang").to_pylist())
    runs += counter.spill(0)
    assert len(runs) > 10
    mergers, unpack = {}, zstandard.ZstdDecompressor()
    for run in runs:
        for row in run.to_pylist():
            mergers.setdefault((row["part"], row["lang"]), q.Merger()).add(unpack.decompress(row["run"]))
    counts, totals, owner = Counter(), Counter(), {}
    for (part, lang), merger in mergers.items():
        result = merger.result(lang, 1).to_pylist()
        assert [r["words"] for r in result[1:]] == sorted((r["words"] for r in result[1:]), key=lambda w: [x.encode() + b"\n" for x in w])
        for r in result:
            if r["words"]:
                assert owner.setdefault((lang, *r["words"][:2], *[""] * (2 - len(r["words"]))), part) == part
                counts[lang, tuple(r["words"])] += r["f"]
            else:
                totals[lang] += r["f"]
    expected, words = Counter(), Counter()
    for text, lang in rows:
        for ws in pieces(text):
            words[lang] += len(ws)
            for size in (1, 2, 3):
                expected.update((lang, tuple(ws[i : i + size])) for i in range(len(ws) - size + 1))
    assert counts == expected and +totals == +words


def test_trie_keeps_its_order(monkeypatch):
    monkeypatch.setattr(q, "BURST", 20)
    random_ = np.random.default_rng(1)
    trie, expected = q.HatTrie(), Counter()
    for _ in range(30):
        # One first word holds most phrases, so its container bursts along the second.
        first = np.where(random_.random(100) < 0.7, 7, random_.integers(1, 50, 100))
        keys = first << 42 | random_.integers(0, 40, 100) << 21 | random_.integers(0, 3, 100)
        keys, counts = np.unique(keys, return_counts=True)
        trie.add(keys, counts)
        expected.update(dict(zip(keys.tolist(), counts.tolist(), strict=True)))
    assert trie.bounds == sorted(trie.bounds) and len(trie.bounds) > 20
    for low, high, held in zip(trie.bounds, [*trie.bounds[1:], 1 << 63], trie.containers, strict=True):
        assert all(low <= k < high for k in held.items()[0].tolist())
    assert Counter({k: c for held in trie.containers for k, c in zip(*(x.tolist() for x in held.items()), strict=True)}) == expected
    assert trie.size == len(expected)
    out = list(trie.spill(len(expected) // 2))
    assert trie.size <= len(expected) // 2 and sum(len(k) for k, _ in out) + trie.size == len(expected)


def test_large_counts_stay_exact(spark):
    a, left, right = 3_000_000_007, 3_000_000_019, 3_000_000_011
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long").selectExpr(q._RATIO.format(a="a", l="l", r="r") + " as s").first()
    assert row.s == 10**6 * a * a // (left * right)


def test_empty_table(no_docs):
    assert q.collocations(no_docs).collect() == []
