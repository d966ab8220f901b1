import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from flowlab.llm import bpe_duck as q
from flowlab.sources.tables import table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_round_trip_of_odd_documents(docs, rows, reference):
    got = sorted(map(tuple, q.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect()), key=repr)
    expected = []
    for r in rows:
        ids = reference.encode_ordinary(r[1] or "")
        sha = [hashlib.sha256(x).hexdigest() for x in (" ".join(map(str, ids)).encode(), (r[1] or "").encode())]
        expected.append((r[0], len(ids), *sha))
    assert got == sorted(expected, key=repr)


def test_encode_and_decode_of_all_documents(spark, data, reference):
    docs = table(spark, data, "documents")
    encoded = q.encode(docs, RANKS, public_tokenizers.PATTERN)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in q.decode(encoded, RANKS, public_tokenizers.PATTERN).collect():
        assert list(r.ids) == reference.encode_ordinary(texts[r.doc_id])
        assert bytes(r.decoded) == texts[r.doc_id].encode()


def test_random_and_long_words(reference):
    r = random.Random(6)
    codec = q.Codec(RANKS, public_tokenizers.PATTERN)
    tokens = [t.decode(errors="ignore") for t in codec.bytes_of]
    texts = ["".join(r.choice("abcdeth in\n\t 1!é汉'  \x1c\x85 ") for _ in range(r.randint(1, 80))) for _ in range(200)]
    texts += ["".join(r.choice(tokens) for _ in range(40)).replace(" ", "") for _ in range(20)]
    texts += ["a" * 3000, "ation" * 60 + "tion" * 60, "".join(r.choice("thisaneonri") for _ in range(400)), "=" * 999, "汉字" * 150]
    assert [i.tolist() for i in codec.encode(texts)] == [reference.encode_ordinary(t) for t in texts]


def test_restarted_recursion(monkeypatch, reference):
    monkeypatch.setattr(q, "KEPT_ROWS", 600)
    codec = q.Codec(RANKS, public_tokenizers.PATTERN)
    word = "thisaneonritheratingnessfully" * 10
    assert codec.encode([word])[0].tolist() == reference.encode_ordinary(word)


def test_no_documents(no_docs):
    assert q.round_trip(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0
    assert q.encode(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0


def test_narrow_split_finds_the_matches_of_the_pattern():
    r = random.Random(7)
    codec = q.Codec(RANKS, public_tokenizers.PATTERN)
    chars = [chr(c) for c in range(ord(q.NARROW))]
    texts = ["".join(r.choices(chars, k=r.randint(0, 60))) for _ in range(2000)] + ["it's we'll  \n\n x ", "".join(chars), ""]
    assert codec.narrow is not None
    assert [codec.narrow.findall(t) for t in texts] == [codec.pattern.findall(t) for t in texts]
    assert codec.split("é汉 x") == codec.pattern.findall("é汉 x")
    # Classes that are not spelled out leave the pattern to the wider library.
    assert q.narrow(r"\w+|\p{L}+") is None and q.narrow(r"[\S]+") is None


def test_words_are_learnt_again_when_forgotten(monkeypatch, reference):
    monkeypatch.setattr(q, "KEPT_WORDS", 3)
    monkeypatch.setattr(q, "NEW_WORDS", 2)
    spelled = q.Spelled(q.Codec(RANKS, public_tokenizers.PATTERN))
    for text in ("seven unheard wordings zq xv", "wordings anew zq", ""):
        ids = reference.encode_ordinary(text)
        written = " ".join(map(str, ids)).encode()
        assert spelled([text]) == [(len(ids), hashlib.sha256(written).hexdigest(), hashlib.sha256(text.encode()).hexdigest())]
