"""Suffix-array deduplication by difference-cover sorting within tasks, dealt by anchors, on bytes.

This stands in for a difference-cover sort distributed over all data: Spark sorts no triples
or ranks. Texts are dealt by winnowed anchors: two equal windows have the same anchor and so reach
the same task, inside the stretches of text around it. Each task sorts the suffixes of its
stretches by difference cover: suffixes at places 1 and 2 modulo 3 are named by their
sorted triples, recursively on the names until these differ; the remaining suffixes follow
from a byte and the next one's rank, and are merged. Neighbours in suffix order whose
prefixes agree over the threshold are repeats.

Cases: a null text is empty. Texts on several rows are compared once; at least one window
long, they are repeats throughout. Matches never cross documents. Repeats within one
document count, so do overlaps. Null and repeated doc_ids need no rule: rows are compared
by content. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlab.llm.anchors import HOT, OWNER, combined, flagged_spans, halves, key_chunks, merged, seed_arrays, sharing_texts, sketches, with_spans
from flowlab.llm.text import BYTES, U64, Slice, byte_prefix, scramble, text_slices
from flowlab.session import materialise

LEAST_BYTES = 200
#: Bytes of an anchor.
SEED = 32
#: Windows of a hot anchor are dealt by this many places at a time.
STEP = 16
#: Bytes of text whose suffixes a task sorts at once.
TASK_BYTES = 512 << 10


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Starts of all suffixes of ``symbols`` (whole numbers from 0) in lexicographic order.

    Places and names are 32-bit numbers; only keys of several of them are wider, and these
    go before the recursion.
    """
    n = len(symbols)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: symbols[i:].tolist()), np.int32)
    s = np.zeros(n + 3, np.int32)
    s[:n] = symbols
    s[:n] += 1
    top = int(s.max()) + 1
    # Sample: places 1 and 2 modulo 3. The place n itself stands between the two halves of names.
    sample = np.concatenate([np.arange(1, n + (n % 3 == 1), 3, dtype=np.int32), np.arange(2, n, 3, dtype=np.int32)])
    by, names = _triple_names(s, sample, top)
    order = by if names is None else suffix_order(names)
    del by, names
    rank = np.zeros(n + 3, np.int32)
    rank[sample[order]] = np.arange(1, len(sample) + 1, dtype=np.int32)
    wide = len(sample) + 2
    sampled = sample[order]
    del sample, order
    sampled = sampled[sampled < n]
    # The remaining suffixes: a symbol, then a ranked suffix.
    zero = np.arange(0, n, 3, dtype=np.int32)
    key = s[zero].astype(np.int64) * wide + rank[zero + 1]
    by = np.argsort(key, kind="stable")
    zero, key = zero[by], key[by]
    del by
    # Merge: against places 1 by (symbol, rank), against places 2 by (two symbols, rank).
    ones = sampled[sampled % 3 == 1]
    before = np.searchsorted(s[ones].astype(np.int64) * wide + rank[ones + 1], key)
    del ones, key
    twos = sampled[sampled % 3 == 2]
    pairs = np.concatenate([s[x].astype(np.int64) * top + s[x + 1] for x in (twos, zero)])
    pairs = np.unique(pairs, return_inverse=True)[1] * wide
    before += np.searchsorted(pairs[: len(twos)] + rank[twos + 2], pairs[len(twos) :] + rank[zero + 2])
    del pairs, twos, rank, s
    out = np.empty(n, np.int32)
    at = np.arange(len(zero)) + before
    rest = np.ones(n, bool)
    rest[at] = False
    out[at], out[rest] = zero, sampled
    return out


def _triple_names(s: np.ndarray, sample: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray | None]:
    """The order of the sampled triples, and their names by place if two are equal."""
    if top < 1 << 21:
        triple = (s[sample].astype(np.int64) * top + s[sample + 1]) * top + s[sample + 2]
        by = np.argsort(triple, kind="stable").astype(np.int32)
        triple = triple[by]
        new = triple[1:] != triple[:-1]
    else:
        by = np.lexsort((s[sample + 2], s[sample + 1], s[sample])).astype(np.int32)
        new = np.zeros(len(by) - 1, bool)
        for k in range(3):
            column = s[sample + k][by]
            new |= column[1:] != column[:-1]
    if new.all():
        return by, None
    names = np.empty(len(sample), np.int32)
    names[by] = np.concatenate([[0], np.cumsum(new, dtype=np.int32)])
    return by, names


def repeated_windows(stretches: list[bytes], holders: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For the windows of all stretches in turn, whether one also starts elsewhere, and where each stretch's begin.

    ``holders``: at how many places each stretch stands.
    """
    distinct: dict[bytes, int] = {}
    which = [distinct.setdefault(s, len(distinct)) for s in stretches]
    times = np.bincount(which, holders, len(distinct))
    sizes = np.array([len(s) for s in distinct], np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1
    data = np.frombuffer(b"\0".join(distinct) + b"\0", np.uint8)
    symbols = data.astype(np.int32) + 1
    symbols[begin + sizes] = 0
    counts = sizes - window + 1
    cuts = np.concatenate([[0], np.cumsum(counts)])
    starts = np.arange(cuts[-1]) + np.repeat(begin - cuts[:-1], counts)
    number = np.full(len(data), -1, np.int32)
    number[starts] = np.arange(len(starts), dtype=np.int32)
    order = suffix_order(symbols)
    del symbols
    order = order[number[order] >= 0]
    # Neighbours agree over a window: compare eight bytes at a time, of those that still agree.
    left, right = order[:-1], order[1:]
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)).view(U64).reshape(-1)
    for k in [*range(0, window - 7, 8), max(window - 8, 0)]:
        agree = eight[left + k] == eight[right + k]
        left, right = left[agree], right[agree]
    flags = np.repeat(times > 1, counts)
    flags[number[left]] = True
    flags[number[right]] = True
    which = np.array(which, np.int64)
    n = counts[which]
    all_cuts = np.concatenate([[0], np.cumsum(n)])
    return flags[np.arange(all_cuts[-1]) + np.repeat(cuts[which] - all_cuts[:-1], n)], all_cuts


def _units(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    return scramble(BYTES.windows(byte_prefix(part.data), SEED)), part.at


def _whole(part: Slice) -> list[str]:
    raw = part.data.tobytes()
    return [hashlib.sha256(raw[x:y]).hexdigest() for x, y in zip(part.at[:-1].tolist(), part.at[1:].tolist(), strict=True)]


def _stretches(texts: DataFrame, window: int) -> DataFrame:
    """(key, stretch, owners): the bytes that the windows around each seed cover, and whose they are.

    A hot anchor's windows are dealt in groups of STEP places, by the bytes that all windows
    of the group hold; equal windows still meet, and nothing else needs to.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            seeds, at = seed_arrays(part.rows.column("seeds"))
            if not at[-1]:
                continue
            text = np.repeat(np.arange(len(at) - 1), np.diff(at))
            begin, hot = part.at[text], seeds["hot"].astype(bool)
            low, high, place = (seeds[c] + begin for c in ("low", "high", "place"))
            key = seeds["key"].astype(np.int64)
            if hot.any():
                group_low, group_high = (place - high)[hot] // STEP, (place - low)[hot] // STEP
                times = group_high - group_low + 1
                source = np.repeat(np.flatnonzero(hot), times)
                group = np.repeat(group_low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                core = place[source] - group * STEP
                prefix = byte_prefix(part.data)
                hashes = BYTES.between(prefix, core, core - STEP + 1 + window)
                new_key = scramble(scramble(hashes) + key[source].view(U64) + group.astype(U64)).view(np.int64)
                new_low = np.maximum(low[source], core - STEP + 1)
                new_high = np.minimum(high[source], core)
                calm = ~hot
                key, low, high = (np.concatenate([x[calm], y]) for x, y in ((key, new_key), (low, new_low), (high, new_high)))
                text = np.concatenate([text[calm], text[source]])
            raw = part.data.tobytes()
            parts = [raw[x : y + window] for x, y in zip(low.tolist(), high.tolist(), strict=True)]
            owners = np.empty(len(text), OWNER)
            owners["a"], owners["b"] = (part.rows.column(c).to_numpy()[text] for c in ("a", "b"))
            owners["low"] = low - part.at[text]
            yield pa.RecordBatch.from_arrays([*combined(key, parts, owners)], ["key", "stretch", "owners"])

    return texts.mapInArrow(run, "key long, stretch binary, owners binary")


def _repeated(stretches: DataFrame, window: int) -> DataFrame:
    """(a, b, spans) of the texts with repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in key_chunks(batches, TASK_BYTES, lambda b: b.column("stretch").nbytes):
            owners = table.column("owners").to_pylist()
            holders = np.array([len(o) // OWNER.itemsize for o in owners])
            flags, cuts = repeated_windows(table.column("stretch").to_pylist(), holders, window)
            yield flagged_spans(flags, cuts, owners, window)

    return stretches.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long, spans binary")


def _removed(found: DataFrame) -> DataFrame:
    """(a, b, n_removed, n_spans, digest, kept): what is left of each text; ``kept`` without cut characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            raw, rows = part.data.tobytes(), []
            for i, spans in enumerate(part.rows.column("spans").to_pylist()):
                gone, at = merged(spans) + part.at[i], part.at[i]
                kept = []
                for x, y in gone.tolist():
                    kept.append(raw[at:x])
                    at = y
                kept = b"".join([*kept, raw[at : part.at[i + 1]]])
                rows.append((int((gone[:, 1] - gone[:, 0]).sum()), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore")))
            if rows:
                types = (pa.int64(), pa.int64(), pa.string(), pa.string())
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.rows.column("a"), part.rows.column("b"), *columns], ["a", "b", "n_removed", "n_spans", "digest", "kept"])

    return found.mapInArrow(run, "a long, b long, n_removed long, n_spans long, digest string, kept string")


def _found(docs: DataFrame, window: int, hot: int, with_text: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sketches of all rows; (a, b, n_removed, n_spans, digest) of changed texts; (a, b) of long texts on several rows."""
    if window <= SEED:
        raise ValueError(f"windows must be longer than {SEED} bytes")
    sketch = materialise(sketches(docs, _units, SEED, window, _whole), "sketches")
    texts = sharing_texts(docs, sketch, F.col("least") < F.col("most"), hot)
    changed = _removed(with_spans(texts, _repeated(_stretches(texts, window), window)))
    changed = materialise(changed if with_text else changed.drop("kept"), "changed")
    copies = sketch.where(F.col("n") >= window).groupBy("a", "b").agg(F.count("*").alias("copies")).where("copies > 1")
    return sketch, changed, materialise(copies, "copies")


def repeats(docs: DataFrame, window: int = LEAST_BYTES, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row.

    Shuffled are anchors, the texts once, and the stretches around shared anchors. A task
    holds whole anchors of at most about TASK_BYTES, or one anchor; a hot anchor's stretches are
    spread by content, and equal stretches are sorted once.
    """
    sketch, changed, copies = _found(docs, window, hot, with_text=False)
    joined = sketch.join(changed, ["a", "b"], "left").join(copies, ["a", "b"], "left")
    copied, hit = F.col("copies").isNotNull(), F.col("n_removed").isNotNull()
    nothing = hashlib.sha256(b"").hexdigest()
    return joined.select(
        "doc_id",
        F.col("n").alias("n_bytes"),
        F.when(copied, F.col("n")).when(hit, F.col("n_removed")).otherwise(0).cast("long").alias("n_removed"),
        F.when(copied, F.lit(1)).when(hit, F.col("n_spans")).otherwise(0).cast("long").alias("n_spans"),
        F.when(copied, F.lit(nothing)).when(hit, F.col("digest")).otherwise(F.col("whole")).alias("kept_sha256"),
    )


def strip(docs: DataFrame, window: int = LEAST_BYTES, hot: int = HOT) -> DataFrame:
    """``docs`` without the repeated bytes in ``text`` and without rows of which nothing is left.

    Bytes of a cut character go with it. ``n_chars``, if there, follows a changed text.
    """
    _, changed, copies = _found(docs, window, hot, with_text=True)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *halves())
    joined = rows.join(changed.select("a", "b", "kept"), ["a", "b"], "left").join(copies, ["a", "b"], "left")
    whole, kept = F.col("copies").isNotNull(), F.col("kept")
    joined = joined.where(~whole & (kept.isNull() | (kept != "")))
    new = {"text": F.coalesce(kept, F.col("row.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(kept.isNull(), F.col("row.n_chars")).otherwise(F.length(kept)).cast(docs.schema["n_chars"].dataType)
    return joined.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
