"""Quality classifier: a linear-chain conditional random field labels every line good or bad.

A line's score sums what its own features and those of the lines before and after it say;
forward and backward messages give each line's marginal. A document's share of good text is
the mean of its lines' marginals weighted by their length, and a logistic curve fitted to the
labelled documents turns it into the score.

The texts are read once: every line becomes a few bytes, and these serve the fit and the
scores. The fit takes all labelled documents outside the held-out fold. Every task climbs the
likelihood over its own share of them, and Spark averages the tasks' parameters, weighted by
their documents, round by round; neither texts nor lines reach the driver.

Cases: a null text is empty; a text without words has the share 0. Very long texts are read
whole, line by line; for the fit, and only there, a long one is cut into sequences. Labels
that are null, not 0 or 1, or that contradict each other for one doc_id are left out; without
usable labels of both kinds every line counts as good. Repeated rows are scored one by one
and count one by one in the fit. A null doc_id is scored and not held out. Extra columns are
not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlab.llm.text import WHITE, WORDS, Slice, scramble, text_slices, window_starts, word_bounds, word_hashes
from flowlab.session import materialise

#: Documents whose crc32(doc_id) leaves this remainder are held out.
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
#: Rounds of the fit; from LEARN_ROUNDS on, a bad document's lines may be good ones.
ROUNDS, LEARN_ROUNDS = 4, 2
#: Labelled documents of one task, and lines of one step and of one sequence of the fit.
TASK_DOCS, STEP_LINES, LONGEST = 4000, 2048, 128
#: Steps of a task in one round at least, and the size of the first round's steps.
STEPS, RATE = 80, 0.4
PENALTY = 1e-4

FEATURES = [
    "always", "no_word", "few_words", "short_line", "long_line", "upper", "symbols", "marked_words", "bars", "exclaims",
    "digits", "markup", "commas", "stops", "ends_sentence", "starts_upper", "same_as_last", "seen_before", "repeated_line",
    "short_words", "long_words", "other_bytes",
]
WIDTH = len(FEATURES)


def _class(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars.encode())] = True
    return table


UPPER, LOWER = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("abcdefghijklmnopqrstuvwxyz")
SYMBOL, MARKUP, DIGIT = _class("#*$%&|<>~^_+@"), _class("<>{}[]=/\\"), _class("0123456789")
SENTENCE = _class(".?!:;\"')")


def _sums(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=out[1:])
    return out


def line_features(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines in 255ths, their lengths in bytes of words, and where each text's lines begin."""
    data, at = part.data, part.at
    starts, ends, first = word_bounds(data, at)
    breaks = np.flatnonzero(data == 10)
    lines = np.sort(np.concatenate([at[:-1], breaks + 1]), kind="stable")
    # An empty text has one empty line; a text's last line ends where the text does.
    line_at = np.concatenate([[0], np.cumsum(np.bincount(np.searchsorted(at, breaks, "right") - 1, minlength=len(at) - 1) + 1)])
    stops = np.empty(len(lines), np.int64)
    stops[:-1] = lines[1:] - 1
    stops[line_at[1:] - 1] = at[1:]
    w0, w1 = np.searchsorted(starts, lines), np.searchsorted(starts, stops)
    words = w1 - w0
    some = np.maximum(words, 1)

    def count(table: np.ndarray) -> np.ndarray:
        sums = _sums(table[data])
        return sums[stops] - sums[lines]

    def share(flags: np.ndarray) -> np.ndarray:
        sums = _sums(flags)
        return (sums[w1] - sums[w0]) / some

    hashes = word_hashes(data, starts, ends)
    last = np.zeros(len(starts), bool)
    last[1:] = hashes[1:] == hashes[:-1]
    last[first[:-1][first[:-1] < len(starts)]] = False
    # Words at the start of three that came before in the text.
    begin, _ = window_starts(first, 3)
    owner = np.searchsorted(first, begin, "right") - 1
    keys = scramble(WORDS.windows(WORDS.prefix(hashes), 3)[begin]) ^ scramble(owner.astype(np.uint64))
    again = np.ones(len(begin), bool)
    again[np.unique(keys, return_index=True)[1]] = False
    seen = np.zeros(len(starts), bool)
    seen[begin[again]] = True
    # Lines with a word that are equal to an earlier one of the text, by their words.
    inside = WORDS.prefix(hashes)
    whole = scramble(WORDS.between(inside, w0, w1)) ^ scramble(words.astype(np.uint64))
    text = np.repeat(np.arange(len(at) - 1), np.diff(line_at))
    whole = np.where(words > 0, whole ^ scramble(text.astype(np.uint64)), scramble(np.arange(len(lines)).astype(np.uint64)) | np.uint64(1))
    repeated = np.ones(len(lines), bool)
    repeated[np.unique(whole, return_index=True)[1]] = False
    repeated &= words > 0

    tail = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    head = data[starts] if len(starts) else np.zeros(0, np.uint8)
    size = ends - starts
    length = count(~WHITE)
    letters, wide = np.maximum(count(UPPER) + count(LOWER), 1), np.maximum(length, 1)
    has = words > 0

    def of_words(flags: np.ndarray, place: np.ndarray) -> np.ndarray:
        return np.where(has, flags[np.clip(place, 0, max(len(flags) - 1, 0))], False) if len(flags) else np.zeros(len(lines), bool)

    shares = [
        np.ones(len(lines)), ~has, (words > 0) & (words < 4), (length > 0) & (length < 30), np.minimum(length / 1000, 1),
        count(UPPER) / letters, np.minimum(4 * count(SYMBOL) / wide, 1), share(SYMBOL[tail]), np.minimum(count(_class("|")) / some, 1),
        np.minimum(count(_class("!")) / some, 1), count(DIGIT) / wide, np.minimum(4 * count(MARKUP) / wide, 1),
        np.minimum(count(_class(",")) / some, 1), np.minimum(count(SENTENCE) / some, 1), of_words(SENTENCE[tail], w1 - 1),
        of_words(UPPER[head] | (head >= 0xC3), w0), share(last), share(seen), repeated, share(size < 3), share(size > 12), count(np.arange(256) > 127) / wide,
    ]
    return np.round(255 * np.stack(shares, 1)).astype(np.uint8), length, line_at


@dataclass
class ChainModel:
    """Weights of a line's own, previous and next features, transition scores, and the curve over shares."""

    emit: np.ndarray = field(default_factory=lambda: np.zeros((WIDTH, 3)))
    move: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    slope: float = 1.0
    shift: float = 0.0

    def flat(self) -> np.ndarray:
        return np.concatenate([self.emit.reshape(-1), self.move.reshape(-1)])

    @staticmethod
    def of(flat: np.ndarray) -> ChainModel:
        return ChainModel(flat[: 3 * WIDTH].reshape(WIDTH, 3).copy(), flat[3 * WIDTH :].reshape(2, 2).copy())


def _good() -> ChainModel:
    """Without labels: every line is good."""
    model = ChainModel()
    model.emit[0, 0] = 50.0
    return model


def _neighbours(at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether a line has one before it, and one after it, in its sequence."""
    before, after = np.ones(n, bool), np.ones(n, bool)
    heads = at[:-1][np.diff(at) > 0]
    before[heads] = False
    after[at[1:][np.diff(at) > 0] - 1] = False
    return before, after


def line_scores(lines: np.ndarray, at: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """The score of good over bad of every line; sequence i holds the lines at[i] to at[i + 1]."""
    own, left, right = (lines @ emit).T
    before, after = _neighbours(at, len(lines))
    out = own.copy()
    out[1:] += np.where(before[1:], left[:-1], 0.0)
    out[:-1] += np.where(after[:-1], right[1:], 0.0)
    return out


def messages(scores: np.ndarray, at: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of good over bad of every line from the lines up to it, and from those after it."""
    (a, b), (c, d) = np.exp(np.clip(move, -30, 30)).tolist()  # bad to bad and good, good to bad and good
    log, exp = math.log, math.exp
    ahead, behind = np.empty(len(scores)), np.zeros(len(scores))
    values = scores.tolist()
    for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if y == x:
            continue
        odds = min(max(values[x], -500.0), 500.0)
        forward = [odds]
        for k in range(x + 1, y):
            e = exp(odds)
            odds = min(max(values[k] + log((b + e * d) / (a + e * c)), -500.0), 500.0)
            forward.append(odds)
        ahead[x:y] = forward
        odds, back = 0.0, [0.0]
        for k in range(y - 1, x, -1):
            e = exp(min(max(odds + values[k], -500.0), 500.0))
            odds = log((c + d * e) / (a + b * e))
            back.append(odds)
        behind[x:y] = back[::-1]
    return ahead, behind


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(x)))


def marginals(lines: np.ndarray, at: np.ndarray, model: ChainModel) -> np.ndarray:
    """The probability of good of every line."""
    ahead, behind = messages(line_scores(lines, at, model.emit), at, model.move)
    return _sigmoid(ahead + behind)


def gradient(flat: np.ndarray, lines: np.ndarray, at: np.ndarray, truth: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Of the weighted log likelihood of the labels ``truth``, by expected against seen features and steps."""
    model = ChainModel.of(flat)
    scores = line_scores(lines, at, model.emit)
    ahead, behind = messages(scores, at, model.move)
    rest = weight * (truth - _sigmoid(ahead + behind))
    before, after = _neighbours(at, len(lines))
    emit = np.stack(
        [rest @ lines, np.where(before[1:], rest[1:], 0.0) @ lines[:-1], np.where(after[:-1], rest[:-1], 0.0) @ lines[1:]], 1
    )
    move = np.zeros((2, 2))
    pair = np.flatnonzero(after[:-1])
    if len(pair):
        reach = scores[pair + 1] + behind[pair + 1]
        table = np.stack([model.move[p, q] + p * ahead[pair] + q * reach for p in (0, 1) for q in (0, 1)])
        table = np.exp(table - table.max(0))
        table /= table.sum(0)
        seen = (2 * truth[pair] + truth[pair + 1]).astype(int)
        w = weight[pair]
        move = (np.bincount(seen, w, 4) - table @ w).reshape(2, 2)
    return np.concatenate([emit.reshape(-1), move.reshape(-1)])


def _line_truth(lines: np.ndarray, at: np.ndarray, quality: np.ndarray, model: ChainModel | None) -> np.ndarray:
    """Labels of the lines: their document's, but good for those of a bad one that look good.

    Of a bad document with words at least its worst line stays bad.
    """
    truth = np.repeat(quality, np.diff(at)).astype(float)
    if model is None:
        return truth
    scores = (lines @ model.emit[:, 0]) + np.where(lines[:, 1] > 0, np.inf, 0)
    for i in np.flatnonzero(quality == 0).tolist():
        own = scores[at[i] : at[i + 1]]
        if len(own):
            truth[at[i] : at[i + 1]] = (own > 0) & (own > own.min())
    return truth


def _climb(flat: np.ndarray, shard: list[tuple[np.ndarray, int]], balance: tuple[float, float], relabel: bool, first: int) -> np.ndarray:
    """Adam over the sequences of one task, from the parameters all tasks share."""
    model = ChainModel.of(flat) if relabel else None
    pieces: list[tuple[np.ndarray, np.ndarray]] = []
    for lines, quality in shard:
        truth = _line_truth(lines, np.array([0, len(lines)]), np.array([quality]), model)
        pieces += [(lines[k : k + LONGEST], np.c_[truth, np.full(len(lines), balance[quality])][k : k + LONGEST]) for k in range(0, len(lines), LONGEST)]
    order = np.random.default_rng(first).permutation(len(pieces))
    batches, held, load = [], [], 0
    for i in order.tolist():
        held.append(pieces[i])
        load += len(pieces[i][0])
        if load >= STEP_LINES:
            batches.append(held)
            held, load = [], 0
    if held:
        batches.append(held)
    w, m1, m2, t = flat.copy(), np.zeros_like(flat), np.zeros_like(flat), 0
    passes = max(1, -(-STEPS // max(len(batches), 1)))
    for _ in range(passes):
        for batch in batches:
            t += 1
            lines = np.concatenate([p[0] for p in batch])
            marks = np.concatenate([p[1] for p in batch])
            at = np.concatenate([[0], np.cumsum([len(p[0]) for p in batch])])
            step = gradient(w, lines, at, marks[:, 0], marks[:, 1]) / len(lines) - PENALTY * w
            m1, m2 = 0.9 * m1 + 0.1 * step, 0.99 * m2 + 0.01 * step**2
            w = w + RATE / first * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
    return w


SKETCH = "doc_id long, quality int, lines binary, lengths binary"


def _unpacked(lines: bytes) -> np.ndarray:
    return np.frombuffer(lines, np.uint8).reshape(-1, WIDTH) / 255.0


def sketch(docs: DataFrame) -> DataFrame:
    """(doc_id, lines, lengths) of every row: packed features and lengths of its lines. The only pass over texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            lines, length, at = line_features(part)
            cuts = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
            length = length.astype("<i4")
            packed = [pa.array([x[a:b].tobytes() for a, b in cuts], pa.binary()) for x in (lines, length)]
            yield pa.RecordBatch.from_arrays([part.rows.column("doc_id"), *packed], ["doc_id", "lines", "lengths"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return keyed.mapInArrow(run, "doc_id long, lines binary, lengths binary")


def _fold(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS


def fit(lines: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> ChainModel:
    """Fit the field and the curve on the labelled rows of :func:`sketch` outside the held-out fold."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
        .where((F.col("low") == F.col("high")) & F.col("low").isin(0, 1) & (_fold() != HELD_OUT))
        .select("doc_id", F.col("low").cast("int").alias("quality"))
    )
    taught = materialise(lines.join(known, "doc_id").select("doc_id", "quality", "lines", "lengths"), "taught")
    sizes = {r["quality"]: r for r in taught.groupBy("quality").agg(F.count("*").alias("docs"), F.sum(F.length("lines")).alias("bytes")).collect()}
    if set(sizes) != {0, 1}:
        return _good()
    shards = max(1, -(-sum(r["docs"] for r in sizes.values()) // TASK_DOCS))
    dealt = materialise(taught.repartition(shards), "dealt")
    # Both kinds weigh the same, however many lines they have.
    total = sizes[0]["bytes"] + sizes[1]["bytes"]
    balance = tuple(0.5 * total / max(sizes[k]["bytes"], 1) for k in (0, 1))
    flat = ChainModel().flat()
    for round_ in range(1, rounds + 1):
        flat = _average(dealt, flat, balance, round_)
    return _curve(dealt, ChainModel.of(flat))


def _average(dealt: DataFrame, flat: np.ndarray, balance: tuple[float, float], round_: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, docs = np.zeros_like(flat), 0

        def learned() -> None:
            nonlocal total, docs, shard
            total, docs = total + len(shard) * _climb(flat, shard, balance, round_ > LEARN_ROUNDS, round_), docs + len(shard)
            shard = []

        shard: list[tuple[np.ndarray, int]] = []
        size = 0
        for batch in batches:
            for packed, quality in zip(batch.column("lines").to_pylist(), batch.column("quality").to_pylist(), strict=True):
                shard.append((_unpacked(packed), quality))
                size += len(packed)
                # A task's memory is bounded by lines, whatever its documents' lengths.
                if size >= 8 << 20:
                    learned()
                    size = 0
        if shard:
            learned()
        if docs:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(total), pa.array(np.full(len(flat), float(docs)))], ["place", "total", "docs"]
            )

    shares = dealt.select("lines", "quality").mapInArrow(run, "place int, total double, docs double")
    rows = shares.groupBy("place").agg((F.sum("total") / F.sum("docs")).alias("value")).collect()
    out = np.zeros_like(flat)
    for r in rows:
        out[r["place"]] = r["value"]
    return out


def _shares(lines: list[bytes], lengths: list[bytes], model: ChainModel) -> np.ndarray:
    """Mean of the marginals of each document's lines, weighted by length; without words 0."""
    at = np.concatenate([[0], np.cumsum([len(x) // WIDTH for x in lines])])
    good = marginals(_unpacked(b"".join(lines)), at, model)
    length = np.frombuffer(b"".join(lengths), "<i4").astype(float)
    weighted = np.concatenate([[0.0], np.cumsum(good * length)])
    total = np.concatenate([[0.0], np.cumsum(length)])
    total = total[at[1:]] - total[at[:-1]]
    return np.clip(np.where(total > 0, (weighted[at[1:]] - weighted[at[:-1]]) / np.maximum(total, 1), 0.0), 0, 1)


def _parts(batch: pa.RecordBatch, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    sizes = np.cumsum(pa.compute.binary_length(batch.column("lines")).to_numpy())
    start = 0
    while start < batch.num_rows:
        base = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, base + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


BINS = 200


def _curve(dealt: DataFrame, model: ChainModel) -> ChainModel:
    """The logistic curve over shares that fits the labelled documents best, from counts per share and label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                share = _shares(part.column("lines").to_pylist(), part.column("lengths").to_pylist(), model)
                yield pa.RecordBatch.from_arrays([pa.array(np.round(share * BINS).astype(np.int32)), part.column("quality")], ["bin", "quality"])

    counts = dealt.mapInArrow(run, "bin int, quality int").groupBy("bin", "quality").count().collect()
    x = np.array([r["bin"] / BINS for r in counts])
    y = np.array([float(r["quality"]) for r in counts])
    n = np.array([float(r["count"]) for r in counts])
    n /= n.sum()
    w = np.zeros(2)
    design = np.c_[x - 0.5, np.ones_like(x)]
    for _ in range(100):
        p = _sigmoid(design @ w)
        slope = design.T @ (n * (y - p)) - 1e-4 * w
        curve = (design * (n * p * (1 - p))[:, None]).T @ design + 1e-4 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        w = w + step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
    return ChainModel(model.emit, model.move, float(w[0]), float(w[1] - 0.5 * w[0]))


SCORED = "doc_id long, score double, good_share double, n_lines long, n_good_lines long"


def score(lines: DataFrame, model: ChainModel) -> DataFrame:
    """(doc_id, held_out, score, predicted, good_share, n_lines, n_good_lines) of every row of :func:`sketch`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCORED.split(", ")]
        for batch in batches:
            for part in _parts(batch):
                packed, lengths = part.column("lines").to_pylist(), part.column("lengths").to_pylist()
                at = np.concatenate([[0], np.cumsum([len(x) // WIDTH for x in packed])])
                good = _sums(marginals(_unpacked(b"".join(packed)), at, model) >= 0.5)
                share = _shares(packed, lengths, model)
                columns = [_sigmoid(model.slope * share + model.shift), share, np.diff(at), good[at[1:]] - good[at[:-1]]]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, columns)], names)

    scored = lines.select("doc_id", "lines", "lengths").mapInArrow(run, SCORED)
    return scored.select(
        "doc_id",
        F.coalesce(_fold() == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "good_share",
        "n_lines",
        "n_good_lines",
    )


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Quality of every document, learned from ``labels`` outside the held-out fold."""
    lines = materialise(sketch(docs), "lines")
    return score(lines, fit(lines, labels))
