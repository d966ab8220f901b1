"""Winnowed anchors: places that equal stretches of text choose alike.

In every window of a fixed number of units (bytes or words) the k-gram with the smallest
hash is the window's anchor. Two equal windows have equal anchors at equal places, so
windows only need to be compared with windows of the same anchor; and consecutive windows
mostly share theirs, so there are few. Shared anchors are found on hashes alone; texts
move only once, to meet the anchors they share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlab.llm.text import U64, Slice, text_slices, window_starts
from flowlab.session import materialise

#: Anchors with more windows' runs than this are dealt by the content around them as well.
HOT = 5000
_PLACE = 26  # low bits that hold a position within a slice


class Runs(NamedTuple):
    """Stretches of consecutive windows with one anchor: its hash and place, first and last window, text."""

    key: np.ndarray
    place: np.ndarray
    low: np.ndarray
    high: np.ndarray
    text: np.ndarray


def smallest_in(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest of every ``width`` consecutive values, by start; of equal ones the last."""
    n = len(values)
    if n >= 1 << _PLACE:
        # Stretches that share all but one unit of a window have every window in one of them.
        step = (1 << _PLACE) - width
        starts = range(0, n - width + 1, step)
        return np.concatenate([smallest_in(values[i : i + step + width - 1], width) + i for i in starts])
    low = U64((1 << _PLACE) - 1)
    keyed = (values & ~low) | (low - np.arange(n, dtype=U64))
    padded = np.full(-(-n // width) * width, ~U64(0))
    padded[:n] = keyed
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(behind[: n - width + 1], ahead[width - 1 : n])
    return (low - (least & low)).astype(np.int64)


def runs(grams: np.ndarray, at: np.ndarray, k: int, window: int) -> Runs:
    """The runs of all texts; ``grams[i]`` hashes units i to i + k, text j has units at[j] to at[j + 1]."""
    starts, _ = window_starts(at, window)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return Runs(none.view(U64), none, none, none, none)
    chosen = smallest_in(grams, window - k + 1)[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(starts)]]) - 1
    place = chosen[first]
    return Runs(grams[place], place, starts[first], starts[last], np.searchsorted(at, place, "right") - 1)


#: What is asked of a text: its units' bounds, its k-gram hashes, its whole digest.
Units = Callable[[Slice], tuple[np.ndarray, np.ndarray]]

_ANCHOR = np.dtype([("key", "<u8"), ("low", "<i4"), ("high", "<i4"), ("place", "<i4")])


def halves() -> list[Column]:
    """a and b: 120 bits of a digest of column ``text``, a null text being empty."""
    digest = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    return [F.conv(F.substring(digest, k, 15), 16, 10).cast("long").alias(c) for k, c in ((1, "a"), (17, "b"))]


def named(docs: DataFrame) -> DataFrame:
    """(doc_id, text, a, b): a null text becomes empty; a and b name the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *halves())


def sketches(docs: DataFrame, units: Units, k: int, window: int, whole: Callable[[Slice], list[str]]) -> DataFrame:
    """(doc_id, a, b, n, whole, anchors): number of units, digest of the whole text, packed runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            grams, at = units(part)
            found = runs(grams, at, k, window)
            packed = np.empty(len(found.key), _ANCHOR)
            begin = at[found.text]
            packed["key"], packed["place"] = found.key, found.place - begin
            packed["low"], packed["high"] = found.low - begin, found.high - begin
            cuts = np.searchsorted(found.text, np.arange(len(at))).tolist()
            anchors = [packed[x:y].tobytes() for x, y in zip(cuts, cuts[1:], strict=False)]
            columns = [part.rows.column(c) for c in ("doc_id", "a", "b")]
            columns += [pa.array(np.diff(at)), pa.array(whole(part), pa.string()), pa.array(anchors, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "a", "b", "n", "whole", "anchors"])

    return named(docs).mapInArrow(run, "doc_id long, a long, b long, n long, whole string, anchors binary")


def _exploded(sketch: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                raw = part.column("anchors").to_pylist()
                flat = np.frombuffer(b"".join(raw), _ANCHOR)
                times = np.array([len(r) // _ANCHOR.itemsize for r in raw], np.int64)
                own = [pa.array(np.repeat(part.column(c).to_numpy(), times)) for c in ("a", "b")]
                columns = [pa.array(flat["key"].astype(U64).view(np.int64)), *own, *(pa.array(flat[c].copy()) for c in ("low", "high", "place"))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "a", "b", "low", "high", "place"])

    return sketch.select("a", "b", "anchors").mapInArrow(run, "key long, a long, b long, low int, high int, place int")


def sharing_texts(docs: DataFrame, sketch: DataFrame, shared: Column, hot: int = HOT) -> DataFrame:
    """(doc_id, a, b, text, seeds) of one row for each distinct text with shared anchors; written.

    ``shared`` tells from min and max over an anchor's runs (columns ``least``, ``most``:
    structs of a, b, low) whether it is shared. Equal texts are one: their equal runs merge
    in partial sums before the shuffle, and ``doc_id`` is their smallest.
    """
    exploded = _exploded(sketch)
    order = F.struct("a", "b", "low")
    counts = exploded.groupBy("key").agg(F.min(order).alias("least"), F.max(order).alias("most"), F.count("*").alias("n"))
    counts = materialise(counts.where(shared).select("key", (F.col("n") > hot).alias("hot")), "anchors")
    seeds = exploded.join(counts, "key").groupBy("a", "b").agg(F.collect_set(F.struct("key", "low", "high", "place", "hot")).alias("seeds"))
    first = F.struct(F.col("doc_id").isNull(), F.col("doc_id"))
    firsts = sketch.groupBy("a", "b").agg(F.min(first).alias("first"))
    wanted = seeds.join(firsts, ["a", "b"]).select("a", "b", F.col("first.doc_id").alias("first"), "seeds")
    texts = named(docs).join(wanted, ["a", "b"]).where(F.col("doc_id").eqNullSafe(F.col("first")))
    texts = materialise(texts.select("doc_id", "a", "b", "text", "seeds"), "sharing")
    # The same id and text on several rows: one of them is enough.
    twice = texts.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1")
    return texts if twice.isEmpty() else materialise(texts.dropDuplicates(["a", "b"]), "sharing")


def seed_arrays(column: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The seeds of all rows as flat arrays, and where each row's begin."""
    flat = column.flatten()
    at = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(column).fill_null(0).to_numpy())])
    return {f: flat.field(f).to_numpy(zero_copy_only=False) for f in ("key", "low", "high", "place", "hot")}, at


def key_chunks(batches: Iterator[pa.RecordBatch], limit: int, weight: Callable[[pa.RecordBatch], int]) -> Iterator[pa.Table]:
    """Rows sorted by ``key`` in tables of whole keys, each of about ``limit`` in weight or of one key."""
    held: list[pa.RecordBatch] = []
    load = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            keys = part.column("key").to_numpy()
            if held and load >= limit:
                last = held[-1].column("key")[-1].as_py()
                change = np.flatnonzero(keys != last)
                cut = int(change[0]) if len(change) else part.num_rows
                if cut:
                    held.append(part.slice(0, cut))
                    load += weight(held[-1])
                if cut < part.num_rows:
                    yield pa.Table.from_batches(held)
                    held, load = [], 0
                part = part.slice(cut)
            if part.num_rows:
                held.append(part)
                load += weight(part)
    if held:
        yield pa.Table.from_batches(held)


OWNER = np.dtype([("a", "<i8"), ("b", "<i8"), ("low", "<i4")])


def combined(key: np.ndarray, parts: list[bytes], owners: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Equal parts of one key as one row with all its owners: what repeats in a slice moves once."""
    rows: dict[tuple[int, bytes], list[int]] = {}
    for i, row in enumerate(zip(key.tolist(), parts, strict=True)):
        rows.setdefault(row, []).append(i)
    packed = [owners[i].tobytes() for i in rows.values()]
    keys, values = zip(*rows, strict=True) if rows else ((), ())
    return pa.array(keys, pa.int64()), pa.array(values, pa.binary()), pa.array(packed, pa.binary())


def flagged_spans(flags: np.ndarray, cuts: np.ndarray, owners: list[bytes], window: int) -> pa.RecordBatch:
    """(a, b, spans): for each owner of a row, the packed units [from, to) that the row's flagged windows cover.

    Row i has the windows cuts[i] to cuts[i + 1]; every owner holds it, each at a place of its own.
    """
    edge = np.diff(flags.astype(np.int8), prepend=0)
    starts = cuts[:-1][cuts[:-1] < cuts[1:]]
    edge[starts] = flags[starts]
    begin = np.flatnonzero(edge == 1)
    last = np.append(~flags[1:], True)[: len(flags)]
    last[cuts[1:][cuts[:-1] < cuts[1:]] - 1] = True
    end = np.flatnonzero(flags & last)
    row = np.searchsorted(cuts, begin, "right") - 1
    flat = np.frombuffer(b"".join(owners), OWNER)
    sizes = np.array([len(o) // OWNER.itemsize for o in owners], np.int64)
    first = np.cumsum(sizes) - sizes
    times = sizes[row]
    span = np.repeat(np.arange(len(row)), times)
    own = flat[np.repeat(first[row], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
    spans = np.empty((len(span), 2), np.int32)
    spans[:, 0] = begin[span] - cuts[row[span]] + own["low"]
    spans[:, 1] = end[span] - cuts[row[span]] + own["low"] + window
    order = np.lexsort((own["b"], own["a"]))
    own, spans = own[order], spans[order]
    new = np.append(True, (own["a"][1:] != own["a"][:-1]) | (own["b"][1:] != own["b"][:-1]))[: len(own)]
    heads = np.flatnonzero(new)
    parts = [spans[x:y].tobytes() for x, y in zip(heads.tolist(), np.append(heads[1:], len(own))[: len(heads)].tolist(), strict=True)]
    columns = [pa.array(own[c][heads].copy()) for c in ("a", "b")]
    return pa.RecordBatch.from_arrays([*columns, pa.array(parts, pa.binary())], ["a", "b", "spans"])


def merged(spans: list[bytes]) -> np.ndarray:
    """The union of packed spans, as rows (from, to)."""
    flat = np.frombuffer(b"".join(spans), np.int32).reshape(-1, 2)
    flat = flat[np.argsort(flat[:, 0], kind="stable")]
    reach = np.maximum.accumulate(flat[:, 1])
    new = np.append(True, flat[1:, 0] > reach[:-1])
    first = np.flatnonzero(new)
    return np.stack([flat[first, 0], reach[np.append(first[1:], len(flat)) - 1]], 1)


def with_spans(texts: DataFrame, flagged: DataFrame) -> DataFrame:
    """(a, b, text, spans) of the texts with flagged runs."""
    spans = flagged.groupBy("a", "b").agg(F.collect_list("spans").alias("spans"))
    return texts.select("a", "b", "text").join(spans, ["a", "b"])
