import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from flowlab.llm import pack_mixture as q

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return t


def check(pieces, rows, tokenizer, length):
    """Every id once, sequences without gaps, all full but the last."""
    left = defaultdict(list)
    for d, t in rows:
        left[d].append(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
    assert set(by_doc) == set(left)
    for d, docs in left.items():
        assert sum(p.length for p in by_doc[d]) == sum(map(len, docs))
        if len(docs) == 1:
            at = 0
            for p in sorted(by_doc[d], key=lambda p: p.start):
                own = docs[0][at : at + p.length]
                assert (p.start, p.doc_tokens) == (at, len(docs[0]))
                assert p.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
                assert list(p.ids) == own
                at += p.length
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for s, parts in sequences.items():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at and size > 0
            at += size
        assert at == length or s == len(sequences) - 1 and at <= length


@pytest.mark.parametrize("targets", [None, {"hot": 0.7, "s0": 0.2, "absent": 3.0}])
def test_odd_documents(docs, rows, tokenizer, targets):
    pieces = q.pack(docs, VOCABULARY, targets, length=256, window=1024, with_ids=True).collect()
    check(pieces, [(r[0], r[1]) for r in rows], tokenizer, 256)


def test_every_window_has_the_target_proportions(spark, tokenizer):
    texts = [(i, f"alpha beta {i} " * (5 + i % 40), "big" if i % 3 else "small") for i in range(400)]
    df = spark.createDataFrame(texts, "doc_id long, text string, source string").repartition(6)
    targets = {"big": 0.25, "small": 0.75}
    pieces = q.pack(df, VOCABULARY, targets, length=128, window=1024).collect()
    share, total = defaultdict(int), defaultdict(int)
    small_left = {}
    for p in pieces:
        place = p.sequence_id * 128 + p.offset
        for t in range(place, place + p.length):
            total[t // 1024] += 1
            share[t // 1024] += p.source == "small"
            if p.source == "small":
                small_left[t // 1024] = True
    last = max(small_left)
    for w in range(last):
        assert total[w] == 1024 and abs(share[w] - 768) <= 2


def test_pieces_of_the_plan_cover_each_queue():
    totals, shares = np.array([5000, 40, 1, 977]), np.array([1.0, 3.0, 0.01, 2.0])
    plan = q.Plan(totals, shares, window=256)
    cuts = plan.cut(np.arange(plan.windows + 1))
    assert (cuts[0] == 0).all() and (cuts[-1] == totals).all() and (np.diff(cuts, axis=0) >= 0).all()
    taken, known = set(), {}
    for queue, n in enumerate(totals.tolist()):
        for start in range(0, n, 90):
            for place, _, size in plan.pieces(queue, start, min(90, n - start), 64, known):
                span = set(range(place, place + size))
                assert not span & taken and place // 64 == (place + size - 1) // 64
                taken |= span
    assert taken == set(range(int(totals.sum())))


def test_ids_by_pieces_are_those_of_whole_texts(rows, tokenizer):
    import base64

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [r[1] or "" for r in rows] + [" lead", "trail ", "a  b", "a \n b", "a\n b", "don't  <|endoftext|> é  x", " ", "  "]
    coded = q._coder(VOCABULARY)(texts)
    for text, ids in zip(texts, coded, strict=True):
        ids = np.frombuffer(ids, np.uint16).tolist()
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids == other.encode_ordinary(text)


def test_added_tokens_are_those_of_the_file(spark):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "é<|endoftext|><|endoftext|> x", "a <|endoftext| > b", "plain"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'s' as source")
    by_file = Tokenizer.from_file(VOCABULARY)
    got = {p.doc_id: list(p.ids) for p in q.pack(df, VOCABULARY, length=4096, with_ids=True).collect()}
    assert got == {i: [*by_file.encode(t, add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    assert got[0] == [64, 220, 50256, 275, 1]


@pytest.mark.parametrize("targets", [None, {"s3": 0.5, "s4": 0.2, "absent": 1.0}])
def test_more_sources_than_a_plan_holds(spark, tokenizer, monkeypatch, targets):
    texts = [(i, f"alpha beta {i} " * (3 + i % 9), f"s{i % 3 if i % 2 else i % 60}") for i in range(300)]
    df = spark.createDataFrame(texts, "doc_id long, text string, source string").repartition(5)
    few = q.pack(df, VOCABULARY, targets, length=128, window=1024, with_ids=True).collect()
    monkeypatch.setattr(q, "QUEUES", 10)
    many = q.pack(df, VOCABULARY, targets, length=128, window=1024, with_ids=True).collect()
    check(many, [t[:2] for t in texts], tokenizer, 128)
    source = {d: s for d, _, s in texts}
    assert all(p.source == source[p.doc_id] for p in many)

    def served(pieces):
        taken = defaultdict(int)
        for p in pieces:
            taken[(p.sequence_id * 128 + p.offset) // 1024, p.source] += p.length
        return taken

    a, b = served(few), served(many)
    assert all(abs(a[c] - b[c]) <= 2 for c in {*a, *b})


def test_no_documents(no_docs):
    assert q.pack(no_docs, VOCABULARY).count() == 0
