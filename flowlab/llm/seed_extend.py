"""Substring deduplication by seed and extend, on words.

Winnowed anchors that several documents share are the seeds. A seed match is extended both
ways to all windows of the threshold length around the anchor; windows that also start in
a document with a smaller id stay flagged, and the union of a document's flagged windows
are its maximal repeats.

Cases: a null text has no words. Only the text of the smallest doc_id of equal texts is
compared; the others of at least one window are repeats throughout. Rows with a null
doc_id have no order, are compared with nothing and keep all words; rows repeating a
doc_id are judged one by one, none of them smaller than the other. Overlaps count once. Extra columns are
not read. Window equality is that of a 64-bit hash of the words' 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlab.llm.anchors import HOT, OWNER, combined, flagged_spans, key_chunks, merged, seed_arrays, sharing_texts, sketches, with_spans
from flowlab.llm.text import U64, WORDS, Slice, scramble, text_slices, word_bounds, word_hashes
from flowlab.session import materialise

LEAST_WORDS = 50
#: Words of an anchor.
SEED = 12


def _units(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = word_bounds(part.data, part.at)
    return scramble(WORDS.windows(WORDS.prefix(word_hashes(part.data, starts, ends)), SEED)), first


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _whole(part: Slice) -> list[str]:
    starts, ends, first = word_bounds(part.data, part.at)
    raw = part.data.tobytes()
    spans = list(zip(starts.tolist(), ends.tolist(), strict=True))
    return [_digest([raw[s:e] for s, e in spans[x:y]]) for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def _extended(texts: DataFrame, window: int) -> DataFrame:
    """(key, hashes, owners): the hash of each window around each seed, packed, and where in the document it is.

    A hot seed's windows are dealt one by one, by their own content. The first packed number
    is the document's id, so that a row is one document's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            starts, ends, first = word_bounds(part.data, part.at)
            hashes = scramble(WORDS.windows(WORDS.prefix(word_hashes(part.data, starts, ends)), window))
            seeds, at = seed_arrays(part.rows.column("seeds"))
            text = np.repeat(np.arange(len(at) - 1), np.diff(at))
            low, high, hot = seeds["low"] + first[text], seeds["high"] + first[text], seeds["hot"].astype(bool)
            ids = part.rows.column("doc_id").to_numpy().tolist()
            doc = [np.int64(i).tobytes() for i in ids]
            calm = ~hot
            packed = [doc[t] + hashes[x : y + 1].tobytes() for t, x, y in zip(text[calm].tolist(), low[calm].tolist(), high[calm].tolist(), strict=True)]
            sizes = (high - low + 1)[hot]
            each = np.repeat(low[hot], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            owner = np.repeat(text[hot], sizes)
            packed += [doc[t] + h.tobytes() for t, h in zip(owner.tolist(), hashes[each], strict=True)]
            key = np.concatenate([seeds["key"][calm].astype(np.int64), hashes[each].view(np.int64)])
            rows = np.concatenate([text[calm], owner])
            owners = np.empty(len(rows), OWNER)
            owners["a"], owners["b"] = (part.rows.column(c).to_numpy()[rows] for c in ("a", "b"))
            owners["low"] = np.concatenate([seeds["low"][calm], each - first[owner]])
            yield pa.RecordBatch.from_arrays([*combined(key, packed, owners)], ["key", "hashes", "owners"])

    return texts.mapInArrow(run, "key long, hashes binary, owners binary")


def _repeated(windows: DataFrame, window: int) -> DataFrame:
    """(a, b, spans) of the texts with windows that a smaller document has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in key_chunks(batches, 1 << 20, lambda b: b.column("hashes").nbytes // 8):
            packed = table.column("hashes").to_pylist()
            numbers = np.frombuffer(b"".join(packed), U64)
            sizes = np.array([len(p) // 8 for p in packed], np.int64)
            head = np.cumsum(sizes) - sizes
            real = np.ones(len(numbers), bool)
            real[head] = False
            hashes = numbers[real]
            cuts = np.concatenate([[0], np.cumsum(sizes - 1)])
            doc = np.repeat(numbers[head].view(np.int64), sizes - 1)
            order = np.argsort(hashes, kind="stable")
            new = np.append(True, hashes[order][1:] != hashes[order][:-1])
            least = np.minimum.reduceat(doc[order], np.flatnonzero(new))
            flags = np.empty(len(hashes), bool)
            flags[order] = doc[order] > least[np.cumsum(new) - 1]
            yield flagged_spans(flags, cuts, table.column("owners").to_pylist(), window)

    return windows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long, spans binary")


def _removed(found: DataFrame) -> DataFrame:
    """(a, b, n_removed, digest, kept, repeats): what is left of each text, and the repeats' words [from, to)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            starts, ends, first = word_bounds(part.data, part.at)
            raw, rows = part.data.tobytes(), []
            for i, spans in enumerate(part.rows.column("spans").to_pylist()):
                gone = merged(spans)
                cover = np.zeros(first[i + 1] - first[i] + 1, np.int64)
                cover[gone[:, 0]] += 1
                cover[gone[:, 1]] -= 1
                stay = first[i] + np.flatnonzero(np.cumsum(cover)[:-1] == 0)
                kept = b" ".join([raw[s:e] for s, e in zip(starts[stay].tolist(), ends[stay].tolist(), strict=True)])
                rows.append((int((gone[:, 1] - gone[:, 0]).sum()), hashlib.sha256(kept).hexdigest(), kept.decode(), ",".join(f"{x}:{y}" for x, y in gone.tolist())))
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.rows.column("a"), part.rows.column("b"), *columns], ["a", "b", "n_removed", "digest", "kept", "repeats"])

    return found.mapInArrow(run, "a long, b long, n_removed long, digest string, kept string, repeats string")


def repeats(docs: DataFrame, window: int = LEAST_WORDS, hot: int = HOT, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, repeats) of every document, and ``kept`` if asked for.

    ``repeats`` lists the maximal repeats as from:to in words. Shuffled are anchors, the
    texts once, and the hashes of windows around shared anchors.
    """
    sketch = materialise(sketches(docs, _units, SEED, window, _whole), "sketches")
    known = sketch.where("doc_id is not null")
    shared = (F.col("least.a") != F.col("most.a")) | (F.col("least.b") != F.col("most.b"))
    texts = sharing_texts(docs.where("doc_id is not null"), known, shared, hot)
    flagged = _repeated(_extended(texts, window), window)
    changed = _removed(with_spans(texts, flagged))
    changed = materialise(changed if with_text else changed.drop("kept"), "changed")
    classes = known.groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    classes = materialise(classes.where("first < last").select("a", "b", "first"), "classes")
    joined = sketch.join(changed, ["a", "b"], "left").join(classes, ["a", "b"], "left")
    copy = F.col("doc_id").isNotNull() & (F.col("doc_id") > F.col("first")) & (F.col("n") >= window)
    hit = F.col("doc_id").isNotNull() & F.col("n_removed").isNotNull()
    out = [
        "doc_id",
        F.col("n").alias("n_words"),
        F.when(copy, F.col("n")).when(hit, F.col("n_removed")).otherwise(0).cast("long").alias("n_removed"),
        F.when(copy, F.lit(_digest([]))).when(hit, F.col("digest")).otherwise(F.col("whole")).alias("kept_sha256"),
        F.when(copy, F.concat(F.lit("0:"), "n")).when(hit, F.col("repeats")).otherwise("").alias("repeats"),
    ]
    return joined.select(*out, *([F.when(copy, F.lit("")).when(hit, F.col("kept")).alias("kept")] if with_text else []))
