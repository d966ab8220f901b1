"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of tokens. A window hands each queue its quota, target proportion
times window length; the fraction of a token that cannot be handed out is its deficit and
is carried to the next window. What a queue has been given after window k has a closed
form, so no window waits for the one before it and every partition cuts its own documents:
a document knows where its tokens lie in its queue, the queue's cuts tell the windows, and
the windows' lengths tell the sequences. All sequences but the last are full.

Cases: a null text is empty and is the end id alone. A null source is a queue of its own,
named "". Repeated rows and null ids are packed like any other row. A target of a source
that does not occur is ignored; a source without a target gets the smallest positive
share, so that nothing is left out; once a queue is empty the others share its quota.
Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlab.llm.text import text_slices
from flowlab.llm.tokens import Coder, file_coder, vocabulary_coder
from flowlab.session import materialise

LENGTH = 2048
#: Tokens of a window: the stretch over which the proportions hold.
WINDOW = 64 * LENGTH
END_ID = 1
#: Queues that a plan holds as arrays; with more, what each gets in each window is a table.
QUEUES = 4096
#: Starts of queue runs that are broadcast; more are joined.
SMALL_STARTS = 200_000

_CODERS: dict[str, Coder] = {}
_FILES: dict[str, Callable[[list[str]], list[bytes]]] = {}


def _coder(vocabulary: str) -> Coder:
    """One coder of ordinary text per worker process."""
    if vocabulary not in _CODERS:
        _CODERS[vocabulary] = vocabulary_coder(vocabulary)
    return _CODERS[vocabulary]


def _file_coder(vocabulary: str) -> Callable[[list[str]], list[bytes]]:
    """One coder by the file's own rules, added tokens included, per worker process."""
    if vocabulary not in _FILES:
        _FILES[vocabulary] = file_coder(vocabulary, _coder(vocabulary))
    return _FILES[vocabulary]


def tokenized(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, queue, part, start, n, ids): ids as 16-bit numbers with the end id, one pass.

    ``part`` numbers the task and ``start`` counts the tokens of the queue before the
    document within it; so each queue is an order of documents without any shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use, end = _file_coder(vocabulary), np.uint16(end_id).tobytes()
        used: dict[str, int] = {}
        for part in text_slices(batches, limit=2 << 20):
            raw = part.data.tobytes()
            texts = [raw[a:b].decode() for a, b in zip(part.at[:-1].tolist(), part.at[1:].tolist(), strict=True)]
            ids = [i + end for i in use(texts)]
            starts = []
            for queue, i in zip(part.rows.column("queue").to_pylist(), ids, strict=True):
                starts.append(used.get(queue, 0))
                used[queue] = starts[-1] + len(i) // 2
            columns = [part.rows.column(c) for c in ("doc_id", "queue", "part")]
            counts = pa.array([len(i) // 2 for i in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(starts, pa.int64()), counts, pa.array(ids, pa.binary())], names)

    names = ["doc_id", "queue", "part", "start", "n", "ids"]
    queue = F.coalesce(F.col("source").cast("string"), F.lit(""))
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        queue.alias("queue"),
        F.spark_partition_id().alias("part"),
    )
    return keyed.mapInArrow(run, "doc_id long, queue string, part int, start long, n long, ids binary")


class Plan:
    """How much of each queue every window takes.

    ``totals``: tokens of each queue; ``shares``: their targets; ``times``: how many queues have these. With v counting rounds of
    unit quota, queue s has been served min(total_s, share_s * v), so the rounds after which
    k windows are full are the inverse of a piecewise linear function, and every queue's
    deficit at any time is under one token.
    """

    def __init__(self, totals: np.ndarray, shares: np.ndarray, window: int = WINDOW, times: np.ndarray | int = 1):
        self.totals, self.window = totals.astype(np.int64), window
        self.shares = shares / (shares * times).sum()
        ends = self.totals / self.shares
        order = np.argsort(ends, kind="stable")
        rate = np.concatenate([[1.0], 1.0 - np.cumsum((self.shares * times)[order])])[:-1]
        self.rounds = np.concatenate([[0.0], ends[order]])
        self.served = np.concatenate([[0.0], np.cumsum(np.diff(self.rounds) * np.maximum(rate, 0))])
        self.windows = int(-(-int((self.totals * times).sum()) // window))

    def cut(self, k: np.ndarray | int) -> np.ndarray:
        """Tokens of every queue given out before window ``k``, one row for each k."""
        k = np.atleast_1d(np.asarray(k, np.int64))
        v = np.interp(k * float(self.window), self.served, self.rounds)
        given = np.minimum(np.floor(v[:, None] * self.shares), self.totals).astype(np.int64)
        given[k >= self.windows] = self.totals
        return given

    def pieces(self, queue: int, start: int, n: int, length: int, known: dict) -> Iterator[tuple[int, int, int]]:
        """(place in the whole order, offset in the document, length) of each piece of a document."""
        stop, at = start + n, start
        k = self._window_of(queue, at, known)
        while at < stop:
            first, last, before = self._window(k, known)
            end = min(stop, int(last[queue]))
            while at < end:
                place = before + int(at - first[queue]) + int(known["lead", k][queue])
                size = min(end - at, length - place % length)
                yield place, at - start, size
                at += size
            k += 1

    def _window(self, k: int, known: dict):
        if k not in known:
            if len(known) > 4096:
                known.clear()
            first, last = self.cut(np.array([k, k + 1]))
            taken = last - first
            known["lead", k] = np.cumsum(taken) - taken
            known[k] = (first, last, int(first.sum()))
        return known[k]

    def _window_of(self, queue: int, at: int, known: dict) -> int:
        """The window in which the queue's token ``at`` is given out."""
        v = at / self.shares[queue]
        k = int(np.clip(np.interp(v, self.rounds, self.served) // self.window, 0, max(self.windows - 1, 0)))
        while self._window(k, known)[1][queue] <= at:
            k += 1
        while self._window(k, known)[0][queue] > at:
            k -= 1
        return k


class Rounds:
    """The plan's formula for one queue at a time, which needs none of the others.

    ``at``: the rounds after which k windows are full; a queue's share is its target, or
    ``least``, or without targets its total, as a part of ``whole``.
    """

    def __init__(self, at: np.ndarray, targets: dict[str, float] | None, least: float, whole: float):
        self.at, self.targets, self.least, self.whole = at, targets, least, whole

    def given(self, k: np.ndarray, share: float, total: int) -> np.ndarray:
        """Tokens of the queue given out before each window ``k``."""
        out = np.minimum(np.floor(self.at[k] * share), total).astype(np.int64)
        out[k >= len(self.at) - 1] = total
        return out

    def cells(self, queue: str, total: int, start: int, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The windows with tokens of the queue from ``start`` to ``stop``: number, these tokens' start and end, the window's first."""
        share = (total if self.targets is None else self.targets.get(queue, self.least)) / self.whole
        windows = len(self.at) - 1
        tokens = np.array([start, stop - 1])
        if stop - start <= 4096:
            tokens = np.arange(start, stop)
        # The end of a token's window is the first k before which the token is given out.
        end = np.clip(np.searchsorted(self.at, (tokens + 1) / share), 1, windows)
        while True:
            late = (end > 1) & (self.given(end - 1, share, total) > tokens)
            early = self.given(end, share, total) <= tokens
            if not (late.any() or early.any()):
                break
            end = end - late + early
        k = np.unique(end - 1) if stop - start <= 4096 else np.arange(end[0] - 1, end[1])
        first, last = self.given(k, share, total), self.given(k + 1, share, total)
        low, high = np.maximum(first, start), np.minimum(last, stop)
        some = low < high
        return k[some], low[some], high[some], first[some]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


def pack(
    docs: DataFrame, vocabulary: str, targets: dict[str, float] | None = None, length: int = LENGTH,
    window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False,
) -> DataFrame:
    """One row per piece: where it lies in its document and in the sequences.

    ``targets``: token proportion of each source, by default what the corpus has. The ids are
    written once, as 16-bit numbers; only counts per task and queue are shuffled and only the
    totals of at most QUEUES queues reach the driver; ``_pack_many`` takes more. With
    ``with_ids`` the ids come too.
    """
    spark = docs.sparkSession
    rows = materialise(tokenized(docs, vocabulary, end_id), "tokenized")
    runs = materialise(rows.groupBy("queue", "part").agg(F.max(F.col("start") + F.col("n")).alias("n")), "runs")
    queues = runs.groupBy("queue").agg(F.sum("n").alias("n"))
    if queues.limit(QUEUES + 1).count() > QUEUES:
        return _pack_many(rows, runs, targets, length, window, with_ids)
    totals = sorted((r.queue, r.n) for r in queues.collect())
    names = [q for q, _ in totals]
    tokens = np.array([n for _, n in totals], np.int64)
    shares = tokens.astype(float)
    if targets:
        given = np.array([max(targets.get(q, 0.0), 0.0) for q in names])
        least = given[given > 0].min() if (given > 0).any() else 1.0
        shares = np.where(given > 0, given, least)
    plan = Plan(tokens, shares, window) if names else None
    # Where each task's run of a queue begins: a sum over tasks, of one row each.
    before = F.sum("n").over(Window.partitionBy("queue").orderBy("part")) - F.col("n")
    starts = runs.select("queue", "part", before.alias("before"))
    if runs.count() <= SMALL_STARTS:
        starts = F.broadcast(starts)
    placed = rows.join(starts, ["queue", "part"]).select("doc_id", "queue", (F.col("start") + F.col("before")).alias("start"), "n", "ids")
    number = {q: i for i, q in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out = []
                columns = [part.column(c).to_pylist() for c in ("doc_id", "queue", "start", "n", "ids")]
                for doc_id, queue, start, n, ids in zip(*columns, strict=True):
                    wide = np.frombuffer(ids, "<u2").astype("<u4").tobytes()
                    for place, cut, size in plan.pieces(number[queue], start, n, length, known):
                        own = wide[4 * cut : 4 * (cut + size)]
                        row = (doc_id, cut, size, zlib.crc32(own), n, place // length, place % length, queue)
                        out.append((*row, np.frombuffer(own, "<u4").astype(np.int32)) if with_ids else row)
                if out:
                    fields = [pa.int64()] * 7 + [pa.string(), pa.list_(pa.int32())][: 1 + with_ids]
                    arrays = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), fields, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, header)

    schema = PIECES + (", ids array<int>" if with_ids else "")
    header = [c.split()[0] for c in schema.split(", ")]
    return placed.mapInArrow(run, schema) if names else spark.createDataFrame([], schema)


def _pack_many(rows: DataFrame, runs: DataFrame, targets: dict[str, float] | None, length: int, window: int, with_ids: bool) -> DataFrame:
    """``pack`` with any number of queues.

    The driver gets the distinct totals, of which T tokens have at most sqrt(2 T), the targeted
    queues and one number per window. What every queue gets in every window is a table of
    non-empty cells, never more than pieces; ids are shuffled once, to meet their cells.
    """
    queues = materialise(runs.groupBy("queue").agg(F.sum("n").alias("n")), "queues")
    named = {q: t for q, t in (targets or {}).items() if t > 0}
    aimed = [r for q in _hundreds(sorted(named)) for r in queues.where(F.col("queue").isin(q)).collect()]
    given = {r.queue: named[r.queue] for r in aimed}
    least = min(given.values(), default=1.0)
    sizes = {r.n: r.times for r in queues.groupBy("n").agg(F.count("*").alias("times")).collect()}
    for r in aimed:
        sizes[r.n] -= 1
    other = [(n, times) for n, times in sorted(sizes.items()) if times]
    totals = np.array([r.n for r in aimed] + [n for n, _ in other], np.int64)
    times = np.array([1] * len(aimed) + [t for _, t in other], np.int64)
    shares = np.array([given[r.queue] for r in aimed] + [least] * len(other)) if targets else totals.astype(float)
    plan = Plan(totals, shares, window, times)
    at = np.interp(np.arange(plan.windows + 1) * float(window), plan.served, plan.rounds)
    rounds = Rounds(at, given if targets else None, least, float((shares * times).sum()))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for queue, n in zip(batch.column("queue").to_pylist(), batch.column("n").to_pylist(), strict=True):
                k, low, high, _ = rounds.cells(queue, n, 0, n)
                yield pa.RecordBatch.from_arrays([pa.array([queue] * len(k), pa.string()), pa.array(k), pa.array(high - low)], ["queue", "k", "taken"])

    cells = queues.mapInArrow(dealt, "queue string, k long, taken long")
    lead = F.sum("taken").over(Window.partitionBy("k").orderBy("queue")) - F.col("taken")
    cells = materialise(cells.select("queue", "k", "taken", lead.alias("lead")), "cells")
    filled = np.zeros(plan.windows + 1, np.int64)
    for r in cells.groupBy("k").agg(F.sum("taken").alias("n")).collect():
        filled[r.k + 1] = r.n
    first_of = np.cumsum(filled)

    by_queue = Window.partitionBy("queue")
    before = F.sum("n").over(by_queue.orderBy("part")) - F.col("n")
    starts = runs.select("queue", "part", before.alias("before"), F.sum("n").over(by_queue).alias("total"))
    placed = rows.join(starts, ["queue", "part"]).select("doc_id", "queue", (F.col("start") + F.col("before")).alias("start"), "n", "total", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                out = []
                columns = [batch.slice(i, 512).column(c).to_pylist() for c in ("doc_id", "queue", "start", "n", "total", "ids")]
                for doc_id, queue, start, n, total, ids in zip(*columns, strict=True):
                    for k, low, high, first in zip(*(c.tolist() for c in rounds.cells(queue, total, start, start + n)), strict=True):
                        out.append((doc_id, queue, n, k, low - start, low - first, ids[2 * (low - start) : 2 * (high - start)]))
                fields = [pa.int64(), pa.string(), *[pa.int64()] * 4, pa.binary()]
                arrays = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), fields, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "queue", "n", "k", "start", "within", "ids"])

    parts = placed.mapInArrow(cut, "doc_id long, queue string, n long, k long, start long, within long, ids binary")
    met = parts.join(cells, ["queue", "k"]).select("doc_id", "queue", "n", "k", "start", (F.col("within") + F.col("lead")).alias("place"), "ids")
    schema = PIECES + (", ids array<int>" if with_ids else "")
    header = [c.split()[0] for c in schema.split(", ")]

    def laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                out = []
                columns = [batch.slice(i, 512).column(c).to_pylist() for c in ("doc_id", "queue", "n", "k", "start", "place", "ids")]
                for doc_id, queue, n, k, start, place, ids in zip(*columns, strict=True):
                    wide, place, done = np.frombuffer(ids, "<u2"), place + int(first_of[k]), 0
                    while done < len(wide):
                        own = wide[done : done + length - place % length].astype("<u4")
                        row = (doc_id, start + done, len(own), zlib.crc32(own.tobytes()), n, place // length, place % length, queue)
                        out.append((*row, own.astype(np.int32)) if with_ids else row)
                        done, place = done + len(own), place + len(own)
                fields = [pa.int64()] * 7 + [pa.string(), pa.list_(pa.int32())][: 1 + with_ids]
                arrays = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), fields, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, header)

    return met.mapInArrow(laid, schema)


def _hundreds(names: list[str]) -> list[list[str]]:
    return [names[i : i + 100] for i in range(0, len(names), 100)]
