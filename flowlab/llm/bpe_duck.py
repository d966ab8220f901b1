"""Byte-level BPE encoding and decoding by recursive DuckDB queries inside each partition.

The distinct words of a slice are token-position rows. Each round of a recursive query
joins neighbours with the merge table and contracts every word's leftmost pair of the
smallest rank, until no pair is left. Decoding joins the ids with the token bytes and
concatenates them in the order of position.

Cases: a null text is empty and has no tokens; ids and decoded bytes of an empty text are
empty. Rows are encoded one by one, so repeated rows and null ids need no rule. Extra
columns are not read. A very long word takes as many rounds as it has distinct ranks,
with its states bounded by restarting the recursion from the last one.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlab.llm.text import text_slices
from flowlab.llm.tokens import Coder

#: Words up to so many bytes contract one pair a round; longer ones all pairs of one rank.
SHORT = 64
#: Bytes of words that one query takes, and rows that one recursion may keep.
QUERY_BYTES = 1 << 17
#: Words whose ids and bytes a worker keeps, and new ones that it takes at a time.
KEPT_WORDS, NEW_WORDS = 800_000, 100_000
KEPT_ROWS = 4 << 20
MEMORY = "300MB"

# pos counts a word's tokens from 0 in every round; rank * 65536 + pos orders pairs by rank, then place.
_SHORT = """
with recursive step(round, word, pos, tok, nxt) as (
  select 0, word, pos, tok, lead(tok) over (partition by word order by pos) from words
  union all
  select * from (
    with best as (
      select s.word, min(m.tok * 65536::bigint + s.pos) as pick
      from step s join merges m on m.pair = s.tok::bigint * 65536 + s.nxt group by s.word)
    select s.round + 1, s.word, case when s.pos > b.pick % 65536 then s.pos - 1 else s.pos end,
      case when s.pos = b.pick % 65536 then (b.pick // 65536)::int else s.tok end,
      case when s.pos = b.pick % 65536 then n.nxt when s.pos + 1 = b.pick % 65536 then (b.pick // 65536)::int else s.nxt end
    from step s join best b on s.word = b.word
      left join step n on n.word = b.word and s.pos = b.pick % 65536 and n.pos = s.pos + 1
    where s.pos <> b.pick % 65536 + 1))
select round, word, pos, tok from step
"""

# All non-overlapping pairs of the smallest rank at once, left to right. Where a merged token
# could form a pair of smaller rank with a neighbour ("watch"), only the leftmost.
_LONG = """
with recursive step(round, word, pos, tok, nxt) as (
  select 0, word, pos, tok, lead(tok) over (partition by word order by pos) from words
  union all
  select * from (
    with pairs as (
      select s.word, s.pos, m.tok, m.watch, min(m.tok) over (partition by s.word) as least
      from step s join merges m on m.pair = s.tok::bigint * 65536 + s.nxt where s.round < $rounds),
    runs as (
      select *, pos - row_number() over (partition by word order by pos) as run, min(pos) over (partition by word) as first
      from pairs where tok = least),
    picked as (
      select word, pos, tok from (select *, min(pos) over (partition by word, run) as head from runs)
      where (pos - head) % 2 = 0 and (not watch or pos = first)),
    after as (
      select s.round + 1 as round, s.word, s.pos, coalesce(p.tok, s.tok) as tok
      from step s left join picked p on p.word = s.word and p.pos = s.pos
        left join picked q on q.word = s.word and q.pos = s.pos - 1
      where q.pos is null and s.word in (select word from picked))
    select round, word, (row_number() over (partition by word order by pos) - 1)::int, tok,
      lead(tok) over (partition by word order by pos) from after))
select s.round, s.word, s.tok from step s join (select word, max(round) as round from step group by word) using (word, round)
order by s.word, s.pos
"""

_DECODE = """
select r.row, string_agg(t.bytes, '' order by r.pos) as bytes
from rows r join tokens t using (tok) group by r.row order by r.row
"""


#: Texts whose characters are all below this one are split by the standard library, at half the cost.
NARROW = "\u0250"
_CLASS = regex.compile(r"\\p\{\w+\}|\\[sS]|\\.|\[\^?|\]")


def narrow(pattern: str) -> re.Pattern | None:
    """``pattern`` with its character classes spelled out below ``NARROW``; None where it holds others than these."""

    def members(name: str) -> str:
        test = regex.compile(name)
        return "".join(re.escape(chr(c)) for c in range(ord(NARROW)) if test.match(chr(c)))

    out, end, inside = [], 0, False
    for m in _CLASS.finditer(pattern):
        out.append(pattern[end : m.start()])
        part, end = m[0], m.end()
        if part[0] == "[":
            inside = True
        elif part == "]":
            inside = False
        elif part == r"\S" and not inside:
            part = f"[^{members(chr(92) + 's')}]"
        elif part[1] in "ps":
            part = members(part) if inside else f"[{members(part)}]"
        else:
            return None
        out.append(part)
    try:
        return re.compile("".join([*out, pattern[end:]]))
    except re.error:
        return None


class Codec:
    """The merge and token tables of one rank file, in an in-memory database of its own."""

    def __init__(self, rank_file: str, pattern: str):
        self.pattern = regex.compile(pattern)
        self.narrow, self.wide = narrow(pattern), re.compile(f"[^\0-{chr(ord(NARROW) - 1)}]")
        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        if max(ranks.values()) >= 65536:
            raise ValueError("ranks must stay under 65536")
        pairs, merged = [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    pairs.append((left, right))
                    merged.append(rank)
        pairs, merged = np.array(pairs, np.int64).reshape(-1, 2), np.array(merged, np.int32)
        # Tokens that, once made, may join a neighbour under a rank smaller than their own.
        watch = np.unique(np.concatenate([pairs[merged < pairs[:, 0], 0], pairs[merged < pairs[:, 1], 1]]))
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.whole = {t: np.uint32(r).tobytes() for t, r in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.base = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY})
        self.base.register("m", pa.table({"pair": pairs[:, 0] * 65536 + pairs[:, 1], "tok": merged, "watch": np.isin(merged, watch)}))
        self.base.execute("create table merges as select * from m")
        hexes = [t.hex() for t in self.bytes_of]
        self.base.register("t", pa.table({"tok": np.arange(len(hexes), dtype=np.int32), "bytes": hexes}))
        self.base.execute("create table tokens as select * from t")
        self.words: dict[str, bytes] = {}
        self.coder = Coder(self.pieces)

    def split(self, text: str) -> list[str]:
        """The matches of the pattern."""
        if self.narrow is None or self.wide.search(text):
            return self.pattern.findall(text)
        return self.narrow.findall(text)

    def _rows(self, words: list[bytes]) -> pa.Table:
        sizes = np.array([len(w) for w in words], np.int64)
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        pos = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return pa.table({"word": word, "pos": pos.astype(np.int32), "tok": self.single[np.frombuffer(b"".join(words), np.uint8)]})

    @staticmethod
    def _split(words: np.ndarray, toks: np.ndarray, n: int) -> list[bytes]:
        cuts = np.searchsorted(words, np.arange(n + 1)).tolist()
        raw = toks.astype(np.uint32).tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _short(self, words: list[bytes]) -> list[bytes]:
        self.base.register("words", self._rows(words))
        out = self.base.sql(_SHORT).to_arrow_table()
        rounds, word, pos, toks = (out.column(c).to_numpy() for c in ("round", "word", "pos", "tok"))
        # A word's ids are those of its last round, in the order of their places.
        last = np.zeros(len(words), rounds.dtype)
        np.maximum.at(last, word, rounds)
        stay = np.flatnonzero(rounds == last[word])
        stay = stay[np.argsort(word[stay].astype(np.int64) << 16 | pos[stay])]
        return self._split(word[stay], toks[stay], len(words))

    def _long(self, word: bytes) -> bytes:
        rows = self._rows([word])
        while True:
            self.base.register("words", rows)
            out = self.base.execute(_LONG, {"rounds": max(1, KEPT_ROWS // rows.num_rows)}).fetchnumpy()
            toks = np.asarray(out["tok"], np.int32)
            if out["round"][0] == 0:
                return toks.astype(np.uint32).tobytes()
            rows = pa.table({"word": np.zeros(len(toks), np.int32), "pos": np.arange(len(toks), dtype=np.int32), "tok": toks})

    def word_ids(self, words: list[str]) -> list[bytes]:
        """The ids of words, without keeping them."""
        kept, self.words = self.words, {}
        self.encode_words(words)
        out, self.words = [self.words[w] for w in words], kept
        return out

    def encode_words(self, words: list[str]) -> None:
        """Put the ids of words not met yet into the table of words."""
        batch: list[str] = []
        raw: list[bytes] = []
        size = 0

        def flush() -> None:
            if batch:
                self.words.update(zip(batch, self._short(raw), strict=True))
                batch.clear()
                raw.clear()

        for word in words:
            token = word.encode()
            if token in self.whole:
                self.words[word] = self.whole[token]
            elif len(token) > SHORT:
                self.words[word] = self._long(token)
            else:
                batch.append(word)
                raw.append(token)
                size += len(token)
                if size >= QUERY_BYTES:
                    flush()
                    size = 0
        flush()

    def pieces(self, texts: list[str]) -> list[bytes]:
        """The ids of each string, matched by the pattern on its own."""
        if len(self.words) > self.coder.kept:
            self.words.clear()
        split = [self.split(t) for t in texts]
        new = {w for words in split for w in words}
        self.encode_words([w for w in new if w not in self.words])
        known = self.words
        return [b"".join([known[w] for w in words]) for words in split]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(b, np.uint32) for b in self.coder(texts)]

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        cuts = np.concatenate([[0], np.cumsum([len(i) for i in ids])])
        return self.decode_flat(np.concatenate([np.zeros(0, np.int32), *ids]), cuts)

    def decode_flat(self, ids: np.ndarray, cuts: np.ndarray) -> list[bytes]:
        """The bytes of the ids cuts[i] to cuts[i + 1], for every i."""
        sizes, n = np.diff(cuts), len(cuts) - 1
        if not len(ids):
            return [b""] * n
        row = np.repeat(np.arange(n, dtype=np.int32), sizes)
        pos = np.arange(len(row)) - np.repeat(cuts[:-1], sizes)
        self.base.register("rows", pa.table({"row": row, "pos": pos.astype(np.int32), "tok": ids.astype(np.int32)}))
        found = self.base.sql(_DECODE).to_arrow_table()
        texts = found.column("bytes").to_pylist()
        # Two hex digits a byte: all texts are read at once and cut.
        raw, ends = bytes.fromhex("".join(texts)), np.zeros(n + 1, np.int64)
        ends[1:][found.column("row").to_numpy()] = np.fromiter(map(len, texts), np.int64, len(texts)) // 2
        ends = np.cumsum(ends).tolist()
        return [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]


_CODECS: dict[tuple[str, str], Codec] = {}
_SPELLED: dict[tuple[str, str], Spelled] = {}


def codec(rank_file: str, pattern: str) -> Codec:
    """One codec per worker process."""
    if (rank_file, pattern) not in _CODECS:
        _CODECS[rank_file, pattern] = Codec(rank_file, pattern)
    return _CODECS[rank_file, pattern]


def spelled(rank_file: str, pattern: str) -> Spelled:
    """One table of spelled words per worker process, on its codec."""
    if (rank_file, pattern) not in _SPELLED:
        _SPELLED[rank_file, pattern] = Spelled(codec(rank_file, pattern))
    return _SPELLED[rank_file, pattern]


def _texts(part) -> list[str]:
    raw = part.data.tobytes()
    return [raw[a:b].decode() for a, b in zip(part.at[:-1].tolist(), part.at[1:].tolist(), strict=True)]


def encode(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of every document; ``rank_file`` must be readable on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(rank_file, pattern)
        for part in text_slices(batches, limit=4 << 20):
            ids = use.encode(_texts(part))
            cuts = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
            values = pa.array(np.concatenate(ids).astype(np.int32)) if len(ids) else pa.array([], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [part.rows.column("doc_id"), pa.ListArray.from_arrays(pa.array(cuts), values)], ["doc_id", "ids"]
            )

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return keyed.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """``encoded`` (doc_id, ids) with ``decoded``, the bytes of the ids; null ids read as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(rank_file, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                rows = batch.slice(start, 256)
                ids = [np.asarray(i.values.to_numpy() if i.is_valid else [], np.int32) for i in rows.column("ids")]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(use.decode(ids), pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


class Numbers(dict):
    """Words numbered as they are first asked for; those not spelled yet stand in ``new``."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        n = self[word] = len(self)
        return n


class Spelled:
    """Of each distinct word the ids as written and the bytes they decode to."""

    def __init__(self, codec: Codec):
        self.codec = codec
        self.number = Numbers()
        self.written: list[bytes] = []
        self.raw: list[bytes] = []
        self.decimal = [b"%d" % i for i in range(len(codec.bytes_of))]

    def learn(self, words: list[str]) -> None:
        ids = self.codec.word_ids(words)
        flat = np.frombuffer(b"".join(ids), np.uint32)
        cuts = np.concatenate([[0], np.cumsum([len(i) >> 2 for i in ids])])
        pieces, ends = list(map(self.decimal.__getitem__, flat.tolist())), cuts.tolist()
        self.written += [b" ".join(pieces[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
        self.raw += self.codec.decode_flat(flat, cuts)

    def __call__(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(number of ids, digest of the ids, digest of the decoded bytes) of each text."""
        if len(self.raw) > KEPT_WORDS:
            self.number, self.written, self.raw = Numbers(), [], []
        split, number = self.codec.split, self.number.__getitem__
        found = [list(map(number, split(t))) for t in texts]
        new, self.number.new = self.number.new, []
        for at in range(0, len(new), NEW_WORDS):
            self.learn(new[at : at + NEW_WORDS])
        out, spelled, bytes_of = [], self.written.__getitem__, self.raw.__getitem__
        for words in found:
            written, raw = b" ".join(map(spelled, words)), b"".join(map(bytes_of, words))
            n = written.count(b" ") + 1 if words else 0
            out.append((n, hashlib.sha256(written).hexdigest(), hashlib.sha256(raw).hexdigest()))
        return out


def round_trip(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every document encoded, its ids decoded, both digested.

    :func:`encode` and :func:`decode` in one pass: a word that was met is encoded and decoded
    once, and a text's ids and bytes are its words' in their order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = spelled(rank_file, pattern)
        for part in text_slices(batches, limit=4 << 20):
            rows = use(_texts(part))
            types = (pa.int64(), pa.string(), pa.string())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([part.rows.column("doc_id"), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return keyed.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
