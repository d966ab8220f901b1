"""N-gram Jaccard join with Bayesian candidate pruning.

MinHash bands propose candidates; a pair's MinHash values are then compared a few at a
time, the pair is dropped once the posterior probability that its similarity reaches the
threshold falls below a tolerance, and the Jaccard coefficient of what is left is exact.

Cases: shingles are sets of five consecutive words; a text of one to four words has one
shingle of them all; a text without words (null, empty, blank) links with nothing. Texts
with equal shingle sets are one class, compared once and counted with its size; so rows
repeating a document link as copies do. A doc_id on rows with different texts stands for each of
them: every row has the links and class of its own text. Rows without a doc_id are returned with a
null class and no link. The smallest doc_id names a class, so ties cannot occur. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlab.llm.blocks import candidate_components, heads_of, in_blocks, per_task
from flowlab.llm.components import components
from flowlab.llm.text import U64, WORDS, Slice, scramble, text_slices, window_starts, word_bounds, word_hashes
from flowlab.session import materialise

SHINGLE = 5
THRESHOLD = 0.8
#: Bands of ROWS MinHash values each: a pair at 0.8 misses all of them with probability 3e-6.
BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
#: Values compared before each look at the posterior, and the least probability to go on.
ROUND = 16
TOLERANCE = 1e-6

_SEED = np.random.default_rng(4)
_FACTOR = _SEED.integers(1, 2**63, HASHES, dtype=U64) * U64(2) + U64(1)
_SHIFT = _SEED.integers(0, 2**63, HASHES, dtype=U64)


def posterior(matches: int, seen: int, threshold: float = THRESHOLD) -> float:
    """P(similarity >= threshold) after ``matches`` of ``seen`` equal values, prior uniform.

    The posterior is Beta(matches + 1, seen - matches + 1); its upper tail with whole-number
    parameters is a binomial sum.
    """
    n = seen + 1
    return sum(math.comb(n, j) * threshold**j * (1 - threshold) ** (n - j) for j in range(matches + 1))


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """After each round, the fewest equal values with which a pair goes on."""
    return [
        next(m for m in range(seen + 1) if posterior(m, seen, threshold) >= tolerance)
        for seen in range(ROUND, HASHES + 1, ROUND)
    ]


def shingles(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """The shingles' hashes of all texts of a slice, and where each text's begin."""
    starts, ends, first = word_bounds(part.data, part.at)
    prefix = WORDS.prefix(word_hashes(part.data, starts, ends))
    counts = np.diff(first)
    short = (counts > 0) & (counts < SHINGLE)
    begin, at = window_starts(first, SHINGLE)
    values = WORDS.between(prefix, begin, begin + SHINGLE)
    if short.any():
        extra = WORDS.between(prefix, first[:-1][short], first[1:][short])
        values = np.insert(values, at[:-1][short], extra)
        at = at + np.concatenate([[0], np.cumsum(short)])
    return scramble(values), at


def minhashes(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of HASHES values for each text; texts without shingles get zeros."""
    out = np.zeros((len(at) - 1, HASHES), np.uint32)
    some = np.flatnonzero(np.diff(at))
    if len(some):
        for k in range(HASHES):
            out[some, k] = np.minimum.reduceat(values * _FACTOR[k] + _SHIFT[k], at[some]) >> U64(32)
    return out


def _fixed(rows: np.ndarray) -> pa.Array:
    """Each row of a matrix as binary."""
    width = rows.shape[1] * rows.itemsize
    offsets = pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, offsets, pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, set_a, set_b, n_shingles, signature): 128 bits name the shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            values, at = shingles(part)
            names = np.zeros((len(at) - 1, 2), np.int64)
            sizes = np.zeros(len(at) - 1, np.int64)
            for i in range(len(sizes)):
                own = np.unique(values[at[i] : at[i + 1]])
                sizes[i] = len(own)
                names[i] = np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), np.int64)
            columns = [part.rows.column("doc_id"), part.rows.column("text_key"), pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array(sizes)]
            yield pa.RecordBatch.from_arrays(
                [*columns, _fixed(minhashes(values, at))], ["doc_id", "text_key", "set_a", "set_b", "n_shingles", "signature"]
            )

    return _keyed(docs).mapInArrow(run, "doc_id long, text_key long, set_a long, set_b long, n_shingles long, signature binary")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), _text_key(text).alias("text_key"))


def _text_key(text: Column) -> Column:
    """Tells the texts of one doc_id apart; a null text is empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _bands(representatives: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signature = _matrix(batch.column("signature"))
            node = batch.column("node").to_numpy(zero_copy_only=False)
            for b in range(BANDS):
                key = np.full(len(node), b, U64)
                for k in range(b * ROWS, (b + 1) * ROWS):
                    key = scramble(key * _FACTOR[0] + signature[:, k])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(node)], ["key", "node"])

    return representatives.select("node", "signature").mapInArrow(run, "key long, node long")


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


def similar_pairs(
    signatures: np.ndarray, sets: list[np.ndarray], own: np.ndarray, low: int, high: int, threshold: float, least: list[int]
) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs at or over the threshold, one of block ``low`` and one of ``high``."""
    n = len(sets)
    rows, columns = np.flatnonzero(own == low), np.flatnonzero(own == high)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    sizes = np.array([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    marked = np.zeros(len(ids) and int(ids.max()) + 1, bool)
    for a in rows.tolist():
        with_ = columns[columns > a] if low == high else columns
        # No coefficient can exceed the ratio of the sizes.
        with_ = with_[np.minimum(sizes[a], sizes[with_]) >= threshold * np.maximum(sizes[a], sizes[with_])]
        matches = np.zeros(len(with_), np.int64)
        for r, fewest in enumerate(least):
            if not len(with_):
                break
            span = slice(r * ROUND, (r + 1) * ROUND)
            matches = matches + (signatures[with_, span] == signatures[a, span]).sum(1)
            stay = matches >= fewest
            with_, matches = with_[stay], matches[stay]
        if not len(with_):
            continue
        marked[ids[cuts[a] : cuts[a + 1]]] = True
        common = np.array([np.count_nonzero(marked[ids[cuts[b] : cuts[b + 1]]]) for b in with_.tolist()])
        marked[ids[cuts[a] : cuts[a + 1]]] = False
        exact = common >= threshold * (sizes[a] + sizes[with_] - common) - 1e-9
        with_ = with_[exact]
        found.append((np.full(len(with_), a), with_))
    if not found or not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _compare(threshold: float, least: list[int]):
    def work(group: pa.Table) -> pa.RecordBatch:
        nodes = group.column("node").to_numpy()
        # A text can stand on several rows of its doc_id; one with the node's own shingle set counts.
        sets, keep = [], {}
        i = 0
        for part in text_slices(group.to_batches()):
            values, at = shingles(part)
            for k in range(len(at) - 1):
                own = np.unique(values[at[k] : at[k + 1]])
                name = np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), np.int64)
                if name[0] == part.rows.column("set_a")[k].as_py() and nodes[i] not in keep:
                    keep[nodes[i]] = i
                    sets.append(own)
                i += 1
        order = np.argsort(list(keep))
        rows = np.array(list(keep.values()))[order]
        sets = [sets[k] for k in order]
        nodes, copies = nodes[rows], group.column("copies").to_numpy()[rows]
        signatures = _matrix(group.column("signature").take(pa.array(rows)))
        own = group.column("own").to_numpy()[rows]
        low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
        a, b = similar_pairs(signatures, sets, own, low, high, threshold, least)
        links = np.bincount(a, copies[b], len(nodes)) + np.bincount(b, copies[a], len(nodes))
        heads = nodes[heads_of(len(nodes), zip(a.tolist(), b.tolist(), strict=True))]
        some = links > 0
        return pa.RecordBatch.from_arrays(
            [pa.array(nodes[some]), pa.array(links[some].astype(np.int64)), pa.array(heads[some])], ["node", "links", "head"]
        )

    return work


def join_similar(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, class_id, set_id, n_links, n_shingles) of every row of ``docs``.

    ``set_id``: smallest doc_id with the same shingle set. ``n_links``: other rows at or over
    the threshold. ``class_id``: smallest doc_id reachable by links.
    """
    return _classed(docs, threshold, tolerance).select("doc_id", "class_id", "set_id", "n_links", "n_shingles")


def _classed(docs: DataFrame, threshold: float, tolerance: float = TOLERANCE) -> DataFrame:
    """``join_similar`` with the text_key of each row and, as class_key, that of its class's first row.

    Shuffled are band keys of the distinct sets, the texts once, and the candidate
    components' texts once for each block they meet. Work within a component is quadratic
    in its distinct sets, spread over blocks; its output is one row per set and block.
    """
    sketch = materialise(sketches(docs), "sketches")
    names = ["set_a", "set_b"]
    known = sketch.where("n_shingles > 0 and doc_id is not null")
    # A set is a node with a number of its own; its smallest row has the text that is compared.
    row = F.struct("doc_id", "text_key")
    classes = known.groupBy(*names).agg(F.min(row).alias("first"), F.count("*").alias("copies"))
    classes = classes.select(*names, "first", "copies", F.monotonically_increasing_id().alias("node"))
    classes = materialise(classes, "classes")
    signed = F.when(row == F.col("first"), F.col("signature"))
    members = known.join(classes, names).select(
        "doc_id", "text_key", "node", "first", "copies", "set_a", "n_shingles", signed.alias("signature")
    )
    members = materialise(members, "members")
    firsts = members.where(row == F.col("first"))
    near = candidate_components(_bands(firsts))
    # A first row repeated is one node.
    nodes = near.join(firsts.dropDuplicates(["node"]), "node").select(
        "node", "component", "first", "copies", "set_a", "signature"
    )
    dealt = in_blocks(materialise(nodes, "nodes"))
    keyed = _keyed(docs)
    own = (dealt["first.doc_id"] == keyed.doc_id) & (dealt["first.text_key"] == keyed.text_key)
    texts = dealt.join(keyed, own).drop("first", "doc_id", "text_key")
    compared = per_task(texts, _compare(threshold, least_matches(threshold, tolerance)), "node long, links long, head long")
    compared = materialise(compared, "compared")
    links = compared.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(compared.select(F.col("node").alias("u"), F.col("head").alias("v")))
    found = links.join(groups, "node", "left").join(classes.select("node", "first"), "node")
    found = materialise(found.select("node", "links", F.coalesce("component", "node").alias("component"), "first"), "links")
    heads = found.groupBy("component").agg(F.min("first").alias("head"))
    found = found.join(heads, "component").select("node", "links", "head")
    head = F.coalesce("head", "first")
    linked = members.join(found, "node", "left").select(
        "doc_id",
        head["doc_id"].alias("class_id"),
        F.col("first.doc_id").alias("set_id"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        "n_shingles",
        "text_key",
        head["text_key"].alias("class_key"),
    )
    own = [F.col("doc_id").alias("class_id"), F.col("doc_id").alias("set_id"), F.lit(0).cast("long").alias("n_links")]
    rest = sketch.where("n_shingles = 0 or doc_id is null").select(
        "doc_id", *own, "n_shingles", "text_key", F.col("text_key").alias("class_key")
    )
    return linked.union(rest)


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, per_id: bool = True) -> DataFrame:
    """Of the rows of each class the first by doc_id; rows without an id stay.

    With ``per_id`` only one of the rows that then share a doc_id is kept; without it all
    their texts are, and a row goes only if its text belongs to a class already kept.
    """
    classes = materialise(_classed(docs, threshold), "classes")
    known = classes.where("doc_id is not null").select("doc_id", "text_key", (F.struct("doc_id", "text_key") != F.struct("class_id", "class_key")).alias("later"))
    keys = ["doc_id", "text_key"]
    left = _matching(docs, known.where("later").select(*keys).distinct(), keys, "left_anti")
    keys = keys[:1] if per_id else keys
    twice = known.where("not later").groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys)
    if twice.isEmpty():
        return left
    once = _matching(left, twice, keys, "left_semi")
    text = _text_key(F.col("text").cast("string"))
    numbered = once.select(F.struct(*once.columns).alias("row"), "doc_id", text.alias("text_key")).dropDuplicates(keys)
    return _matching(left, twice, keys, "left_anti").union(numbered.select("row.*"))


def _matching(docs: DataFrame, keyed: DataFrame, keys: list[str], how: str) -> DataFrame:
    """The rows of ``docs`` with (left_semi) or without (left_anti) their doc_id and text_key in ``keyed``."""
    own = {"doc_id": docs["doc_id"].cast("long"), "text_key": _text_key(docs["text"].cast("string"))}
    same = [own[k] == keyed[k] for k in keys]
    return docs.join(keyed, same, how)
