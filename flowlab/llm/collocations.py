"""Phrase collocations counted by burst tries whose subtrees are spilled as sorted runs.

Every task counts the phrases of its texts in a HAT-trie: hash containers under a shallow trie
of word ids. A container that grows too large bursts into two along a word id, first of the
phrase's first word and, below a single first word, of its second. When the task holds too
much, whole subtrees leave it as runs sorted by words. Runs are dealt by prefix (a phrase's first
two words), and a prefix partition's runs are merged in order into total counts. Scores,
dropped candidates and ranks are joins and windows over the counted phrases.

Cases: a null text is empty, a null lang is ``und`` and joins documents whose lang is that
string. Empty texts and texts of separators have no words. Very long texts and words are read
whole. Repeated rows count as often as they stand there. Extra columns are not read, whatever
their names. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowlab.llm.text import Slice, scramble, text_slices
from flowlab.session import materialise

LONGEST = 3
LEAST = 10
FIRST = 2000
#: A container bursts beyond this many phrases, a task spills beyond that many.
BURST, HELD = 1 << 16, 1_000_000
#: Parts of a language that are ranked on their own first.
SALTS = 32
#: Bytes of text per prefix partition.
PART_BYTES = 3 << 20
#: Shuffle partitions at most; beyond them one holds several prefix partitions, merged in turn.
SHUFFLE = 20_000
#: Word ids have 21 bits, so that three of them make one key; with so many words a task starts anew.
BITS = 21
WORDS = 200_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
BREAK = np.zeros(256, bool)
BREAK[list(b".,;:!?\x0a\x0b\x0c\x0d")] = True
GAP = BREAK.copy()
GAP[[0x20, 0x09]] = True


class Container:
    """A hash table from keys to counts in two arrays, open addressing; key 0 marks a free slot."""

    def __init__(self, slots: int = 1 << 10):
        self.keys, self.counts, self.size = np.zeros(slots, np.int64), np.zeros(slots, np.int64), 0

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        used = np.flatnonzero(self.keys)
        return self.keys[used], self.counts[used]

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Add counts of distinct keys, all at once: what meets another key moves on to the next slot."""
        if 2 * (self.size + len(keys)) > len(self.keys):
            held = self.items()
            self.__init__(1 << (4 * (self.size + len(keys)) - 1).bit_length())
            if len(held[0]):
                self.add(*held)
        table, mask = self.keys, len(self.keys) - 1
        slot = ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - mask.bit_length())).view(np.int64)
        while len(keys):
            free = table[slot] == 0
            table[slot[free]] = keys[free]
            own = table[slot] == keys
            self.counts[slot[own]] += counts[own]
            self.size += int((own & free).sum())
            rest = ~own
            keys, counts, slot = keys[rest], counts[rest], (slot[rest] + 1) & mask


class HatTrie:
    """Counts of keys of three word ids (0: none), in hash containers that cover ranges of keys.

    ``bounds`` are the lower ends of the containers in order, which is the trie read from left
    to right: a bound that has only a first word is a child of the root, one with a second word
    hangs below its first.
    """

    def __init__(self) -> None:
        self.bounds: list[int] = [0]
        self.containers: list[Container] = [Container()]
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Add counts of sorted distinct keys."""
        cuts = np.searchsorted(keys, np.array(self.bounds[1:], np.int64)).tolist()
        full = []
        for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(keys)], strict=True)):
            if a < b:
                held = self.containers[i]
                self.size -= held.size
                held.add(keys[a:b], counts[a:b])
                self.size += held.size
                if held.size > BURST:
                    full.append(self.bounds[i])
        for bound in full:
            self._burst(bound)

    def _burst(self, bound: int) -> None:
        i = bisect_right(self.bounds, bound) - 1
        keys, counts = self.containers[i].items()
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        middle = int(keys[len(keys) // 2])
        # Cut before a first word; where there is only one, before a second one.
        for shift in (2 * BITS, BITS):
            for cut in (middle >> shift << shift, ((middle >> shift) + 1) << shift):
                if keys[0] < cut <= keys[-1]:
                    at = int(np.searchsorted(keys, cut))
                    halves = [Container(), Container()]
                    halves[0].add(keys[:at], counts[:at])
                    halves[1].add(keys[at:], counts[at:])
                    self.bounds.insert(i + 1, cut)
                    self.containers[i : i + 1] = halves
                    for k in (i + 1, i):
                        if self.containers[k].size > BURST:
                            self._burst(self.bounds[k])
                    return

    def spill(self, keep: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Take whole subtrees out, the largest first, until at most ``keep`` keys stay."""
        for i in sorted(range(len(self.containers)), key=lambda i: -self.containers[i].size):
            if self.size <= keep:
                return
            held = self.containers[i]
            if held.size:
                self.containers[i] = Container()
                self.size -= held.size
                yield held.items()


def _words(part: Slice) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of a slice, of each its text, and whether the next word follows in its piece."""
    data, at = _LOWER[part.data], part.at
    solid = ~GAP[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before = np.append(False, solid[:-1])[:n]
    after = np.append(solid[1:], False)[:n]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    cuts = np.zeros(n + 1, np.int32 if n < 1 << 31 else np.int64)
    np.cumsum(BREAK[data], out=cuts[1:])
    text = np.searchsorted(at, starts, "right") - 1
    joined = np.zeros(len(starts), bool)
    joined[:-1] = (cuts[ends[:-1]] == cuts[starts[1:]]) & (text[:-1] == text[1:])
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(data[solid])]
    return pa.Array.from_buffers(pa.large_binary(), len(starts), buffers), text, joined


class Counter:
    """One task's trie and word ids; a word of one language has one id."""

    def __init__(self, parts: int):
        self.parts = parts
        self.pack = zstandard.ZstdCompressor(level=1)
        self._anew()

    def _anew(self) -> None:
        self.trie = HatTrie()
        self.ids: dict[str, dict[bytes, int]] = {}
        self.words, self.langs = [b""], [""]

    def add(self, part: Slice, langs: list[str]) -> Iterator[pa.RecordBatch]:
        words, text, joined = _words(part)
        if not len(words):
            return
        coded = words.dictionary_encode()
        known = coded.dictionary.to_pylist()
        distinct = sorted(set(langs))
        place = {lang: i for i, lang in enumerate(distinct)}
        lang = np.array([place[x] for x in langs], np.int64)[text]
        pairs, which = np.unique(lang * len(known) + coded.indices.to_numpy().astype(np.int64), return_inverse=True)
        if len(self.words) > WORDS:
            yield from self.spill(0)
            self._anew()
        cuts = np.searchsorted(pairs, np.arange(len(distinct) + 1) * len(known)).tolist()
        here: list[int] = []
        for tongue, x, y in zip(distinct, cuts, cuts[1:], strict=False):
            table = self.ids.setdefault(tongue, {})
            names = [known[k] for k in (pairs[x:y] % len(known)).tolist()]
            for name in [n for n in names if n not in table]:
                table[name] = len(self.words)
                self.words.append(name)
                self.langs.append(tongue)
            here += map(table.__getitem__, names)
        here = np.array(here, np.int64)
        one = here[which] << 2 * BITS
        two = one[:-1][joined[:-1]] | (one[1:] >> BITS)[joined[:-1]]
        run = joined[:-2] & joined[1:-1]
        three = one[:-2][run] | (one[1:-1] >> BITS)[run] | (one[2:] >> 2 * BITS)[run]
        for keys in (one, two, three):
            keys = np.sort(keys)
            heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
            self.trie.add(keys[heads], np.diff(np.append(heads, len(keys))))
        if self.trie.size > HELD:
            yield from self.spill(HELD // 2)

    def spill(self, keep: int) -> Iterator[pa.RecordBatch]:
        taken = list(self.trie.spill(keep))
        if taken:
            keys, counts = (np.concatenate(x) for x in zip(*taken, strict=True))
            yield self._runs(keys, counts)

    def _runs(self, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        """One row per language and prefix partition: its phrases in the order of their words."""
        mask = (1 << BITS) - 1
        places = [keys >> 2 * BITS, keys >> BITS & mask, keys & mask]
        flags = np.zeros(len(self.words), bool)
        for x in places:
            flags[x] = True
        flags[0] = True
        used = np.flatnonzero(flags).tolist()
        named = sorted(zip([self.langs[i] for i in used], [self.words[i] for i in used], used, strict=True))
        rank = np.zeros(len(self.words), np.int64)
        rank[[i for _, _, i in named]] = np.arange(len(named))
        langs, lang = np.unique([x for x, _, _ in named], return_inverse=True)
        hashes = np.array([crc32(w) for _, w, _ in named], np.uint64)
        words = pa.array([w + b"\n" for _, w, _ in named], pa.large_binary())
        a, b, c = (rank[x] for x in places)
        part = (scramble(scramble(hashes[a]) + hashes[b]) % np.uint64(self.parts)).astype(np.int64)
        # In the order of words, which is also that of languages; then dealt to the partitions.
        by = np.argsort(a << 2 * BITS | b << BITS | c)
        by = by[np.argsort(part[by].astype(np.uint16) if self.parts < 1 << 16 else part[by], kind="stable")]
        a, b, c, part, counts = a[by], b[by], c[by], part[by], counts[by]
        tongue = lang[a]
        new = np.append(True, (part[1:] != part[:-1]) | (tongue[1:] != tongue[:-1]))
        heads = np.flatnonzero(new)
        runs = [self.pack.compress(r) for r in packed_runs(a, b, c, counts, heads, words)]
        return pa.RecordBatch.from_arrays([pa.array(part[heads]), pa.array(langs[tongue[heads]].tolist(), pa.string()), pa.array(runs, pa.binary())], ["part", "lang", "run"])


def packed_runs(a: np.ndarray, b: np.ndarray, c: np.ndarray, counts: np.ndarray, heads: np.ndarray, words: pa.Array) -> Iterator[bytes]:
    """Every sorted run as a trie level by level: words in order, how many children each has, counts.

    Runs begin at ``heads``; ``b`` and ``c`` are the empty word's number where a phrase ends before.
    The words of a level end with a line feed, which no word holds.
    """
    first = np.zeros(len(a), bool)
    first[heads] = True
    top = first | np.append(True, a[1:] != a[:-1])
    mid = top | np.append(True, b[1:] != b[:-1])
    tops, mids = np.flatnonzero(top), np.flatnonzero(mid)
    sizes = [np.diff(np.append(np.searchsorted(mids, tops), len(mids))).astype("<i4"), np.diff(np.append(mids, len(a))).astype("<i4"), counts.astype("<i8")]
    levels = []
    for which in (a[tops], b[mids], c):
        taken = words.take(pa.array(which))
        levels.append((np.frombuffer(taken.buffers()[1], np.int64), memoryview(taken.buffers()[2])))
    ends = np.append(heads, len(a))
    cuts = np.stack([np.searchsorted(tops, ends), np.searchsorted(mids, ends), ends], 1).tolist()
    for x, y in zip(cuts, cuts[1:], strict=False):
        texts = [data[at[p] : at[q]] for (at, data), p, q in zip(levels, x, y, strict=True)]
        head = np.array([q - p for p, q in zip(x, y, strict=True)] + [len(t) for t in texts], "<i8").tobytes()
        yield b"".join([head, *[n[p:q].tobytes() for n, p, q in zip(sizes, x, y, strict=True)], *texts])


def read_run(raw: bytes) -> tuple[list[bytes], list[np.ndarray]]:
    *numbers, l0, l1, l2 = np.frombuffer(raw, "<i8", 6).tolist()
    at = 48
    sizes = []
    for n, kind in zip(numbers, ("<i4", "<i4", "<i8"), strict=True):
        sizes.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return [raw[at : at + l0], raw[at + l0 : at + l0 + l1], raw[at + l0 + l1 : at + l0 + l1 + l2]], sizes


def _lines(text: bytes) -> pa.Array:
    """The words of a text in which each ends with a line feed, with it."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.append(0, ends)), pa.py_buffer(text)])


class Merger:
    """The sorted phrases of one prefix partition and language with their counts so far."""

    #: Phrases that wait until they are merged in.
    WAITING = 1 << 20

    def __init__(self) -> None:
        self.words = _lines(b"\n")
        self.columns = [np.zeros(0, np.int32)] * 3 + [np.zeros(0, np.int64)]
        self.held: list[tuple[list[bytes], list[np.ndarray]]] = []
        self.load = 0

    def add(self, raw: bytes) -> None:
        self.held.append(read_run(raw))
        self.load += len(self.held[-1][1][2])
        if self.load >= self.WAITING:
            self.merge()

    def merge(self) -> None:
        """Number the words in their order; every run's keys then ascend, and a stable sort merges them."""
        if not self.held:
            return
        levels = [_lines(b"".join(texts[k] for texts, _ in self.held)) for k in range(3)]
        n0, n1, counts = (np.concatenate([sizes[k] for _, sizes in self.held]) for k in range(3))
        self.held, self.load = [], 0
        coded = pa.concat_arrays([self.words, *levels]).dictionary_encode()
        order = pa.compute.array_sort_indices(coded.dictionary)
        rank = np.empty(len(order), np.int32)
        rank[order.to_numpy()] = np.arange(len(order), dtype=np.int32)
        codes = rank[coded.indices.to_numpy()]
        cuts = np.cumsum([len(self.words), *map(len, levels)]).tolist()
        self.words = coded.dictionary.take(order)
        a, b, c = (codes[x:y] for x, y in zip(cuts, cuts[1:], strict=False))
        a, b = np.repeat(np.repeat(a, n0), n1), np.repeat(b, n1)
        a, b, c = (np.concatenate([codes[old], x]) for old, x in zip(self.columns[:3], (a, b, c), strict=True))
        counts = np.concatenate([self.columns[3], counts])
        bits = max(len(order) - 1, 1).bit_length()
        if 3 * bits <= 63:
            key = a.astype(np.int64) << 2 * bits | b.astype(np.int64) << bits | c
            by = np.argsort(key, kind="stable")
            key = key[by]
            new = np.append(True, key[1:] != key[:-1])
        else:
            by = np.lexsort((c, b, a))
            new = np.append(True, (np.diff(a[by]) != 0) | (np.diff(b[by]) != 0) | (np.diff(c[by]) != 0))
        heads = np.flatnonzero(new)
        self.columns = [x[by][heads] for x in (a, b, c)] + [np.add.reduceat(counts[by], heads)]

    def result(self, lang: str, least: int) -> pa.RecordBatch:
        """(lang, words, f) of the phrases found ``least`` times, and one row without words for all occurrences."""
        self.merge()
        a, b, c, n = self.columns
        none = pa.compute.index(self.words, pa.scalar(b"\n", pa.large_binary())).as_py()
        total = int(n[b == none].sum())
        stay = np.flatnonzero(n >= least)
        columns = [self.words.take(pa.array(x[stay])).to_pylist() for x in (a, b, c)]
        words = [[w[:-1].decode() for w in row if w != b"\n"] for row in zip(*columns, strict=True)]
        columns = [pa.array([lang] * (len(words) + 1), pa.string()), pa.array([[], *words], pa.list_(pa.string())), pa.array([total, *n[stay].tolist()], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["lang", "words", "f"])


def count_phrases(docs: DataFrame, least: int = LEAST, parts: int | None = None) -> DataFrame:
    """(lang, words, f) of all phrases of up to three words found at least ``least`` times; written.

    Rows without words hold what a prefix partition adds to the number of words of its language.
    """
    text = F.col("text").cast("string")
    keyed = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text.alias("text"))
    if parts is None:
        size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(1, -(-size // PART_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(parts)
        for part in text_slices(batches, limit=2 << 20):
            yield from counter.add(part, part.rows.column("lang").to_pylist())
        yield from counter.spill(0)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        merger, here = None, None
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("part", "lang", "run")), strict=True):
                part, lang = row[0].as_py(), row[1].as_py()
                if here != (part, lang):
                    if merger:
                        yield merger.result(here[1], least)
                    merger, here = Merger(), (part, lang)
                merger.add(unpack.decompress(row[2].as_py()))
        if merger:
            yield merger.result(here[1], least)

    runs = keyed.mapInArrow(run, "part long, lang string, run binary")
    runs = runs.repartition(min(parts, SHUFFLE), "part", "lang").sortWithinPartitions("part", "lang")
    return materialise(runs.mapInArrow(merge, "lang string, words array<string>, f long"), "phrases")


_RATIO = "cast(cast({a} as decimal(15,0)) * cast({a} as decimal(15,0)) * 1000000bd as decimal(38,0)) div (cast({l} as decimal(15,0)) * cast({r} as decimal(15,0)))"


def collocations(docs: DataFrame, least: int = LEAST, first: int = FIRST, covered_percent: int = 50) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``first`` phrases of two or three words by score."""
    counted = count_phrases(docs, least)
    sizes = counted.groupBy("lang").agg(F.sum(F.when(F.size("words") == 0, F.col("f"))).alias("n"))
    phrases = counted.where(F.size("words") > 0).select("lang", "words", F.array_join("words", " ").alias("phrase"), "f")
    candidates = phrases.where(F.size("words") > 1)
    # Every cut of every candidate looks both its parts up.
    cut = F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")
    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), "words", cut)
    part = lambda start, length: F.array_join(F.slice("words", start, length), " ")
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.size("words") - F.col("k")).alias("right"))
    left = phrases.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = phrases.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    cuts = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"])
    score = F.expr(_RATIO.format(a="a", l="l", r="r")).cast("long")
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"), F.first("a").alias("a"))
    # What most of a phrase's occurrences extend.
    inner = F.filter(
        F.flatten(F.transform(F.sequence(F.lit(1), F.size("words")), lambda i: F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda n: F.slice("words", i, n)))),
        lambda x: F.size(x) > 1,
    )
    longer = candidates.where(F.size("words") > 2).select("lang", F.explode(F.array_distinct(inner)).alias("inner"), "f")
    longer = longer.groupBy("lang", F.array_join("inner", " ").alias("phrase")).agg(F.max("f").alias("longer"))
    stay = best.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < covered_percent * F.col("a")))
    # A language's first ones are among the first of each of its parts.
    salted = stay.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    order = [F.desc("best.score"), F.desc("a"), "phrase"]
    near = salted.withColumn("near", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("near") <= first)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"))


SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
words as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]'), lambda x: x <> '') as w from pieces),
grams as (
  select lang, 1 as size, unnest(w) as phrase from words
  union all
  select lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from words
  union all
  select lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) from words),
counted as (select lang, size, phrase, count(*) as f from grams group by all),
sizes as (select lang, sum(f) as n from counted where size = 1 group by lang),
candidates as (select lang, size, phrase, f as a, string_split(phrase, ' ') as w from counted where size > 1 and f >= 10),
parts as (
  select lang, phrase, a, k, array_to_string(w[:k], ' ') as head, array_to_string(w[k + 1:], ' ') as tail
  from (select *, unnest(range(1, size)) as k from candidates)),
cuts as (
  select c.lang, c.phrase, c.a, k, l.f as l, r.f as r, 1000000::hugeint * c.a::hugeint * c.a::hugeint // (l.f::hugeint * r.f::hugeint) as score
  from parts c join counted l on l.lang = c.lang and l.phrase = c.head join counted r on r.lang = c.lang and r.phrase = c.tail),
best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
longer as (
  select lang, array_to_string(w[1:2], ' ') as phrase, a from candidates where size = 3
  union all
  select lang, array_to_string(w[2:3], ' '), a from candidates where size = 3),
stay as (
  select b.* from best b where not exists (
    select 1 from longer x where x.lang = b.lang and x.phrase = b.phrase and 100 * x.a >= 50 * b.a)),
ranked as (
  select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from stay)
select lang, rank, phrase, a, l, r, n::bigint as n, score::bigint as score from ranked join sizes using (lang) where rank <= 2000
"""
