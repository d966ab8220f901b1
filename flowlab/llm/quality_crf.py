"""Quality rules: a linear-chain conditional random field marks content and boilerplate lines.

Cases: a null text has no words. A text without words fails the base rule. Null or
conflicting quality labels are left out of the fit; with no usable label of either kind
there is nothing to tell apart, and every line counts as content. Rows are judged one by
one: a repeated row gets its verdict twice, a null doc_id keeps its row. Extra columns are
not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlab.llm.text import WHITE, WORDS, Slice, scramble, text_slices, window_starts, word_bounds, word_hashes

MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30
#: A document stays if at least this share of its words lies in content lines.
KEEP_SHARE = 0.5
#: The fit takes at most so many labelled documents of either kind, each of at most so many bytes.
FIT_DOCS = 800
FIT_BYTES = 8_000

FEATURES = [
    "always", "no_word", "few_words", "some_words", "upper", "mostly_upper", "some_symbols", "many_symbols", "pipes",
    "exclaims", "digits", "markup", "ends_sentence", "starts_upper", "repeated_line", "repeated_words", "short_words",
    "long_words", "commas", "first",
]


def _class(chars: str | bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars.encode() if isinstance(chars, str) else chars)] = True
    return table


UPPER, LOWER = _class(bytes(range(65, 91))), _class(bytes(range(97, 123)))
DIGIT, SYMBOL, MARKUP = _class("0123456789"), _class("#*$%&|<>"), _class("<>{}[]=/\\")
CONTINUES = _class(bytes(range(0x80, 0xC0)))
PIPE, EXCLAIM, COMMA, SENTENCE = _class("|"), _class("!"), _class(","), _class(".?!:;\"')")


@dataclass
class LineModel:
    """``emit``: the score of content over boilerplate of each feature; ``move[a, b]``: of label b after a."""

    emit: np.ndarray
    move: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    def scores(self, masks: np.ndarray) -> np.ndarray:
        bits = (masks[:, None] >> np.arange(len(FEATURES))) & 1
        return bits @ self.emit


#: Without labels: every line is content.
ALL_CONTENT = LineModel(np.eye(len(FEATURES))[0])


class Measures:
    """Counts per text and a feature mask per line of one slice."""

    def __init__(self, part: Slice):
        data, at = part.data, part.at
        n = len(at) - 1
        starts, ends, first = word_bounds(data, at)
        self.n_words = np.diff(first)
        solid = np.zeros(len(data) + 1, np.int64)
        inside = np.zeros(len(data) + 1, np.int64)
        np.add.at(inside, starts, 1)
        np.subtract.at(inside, ends, 1)
        np.cumsum((np.cumsum(inside[:-1]) > 0) & ~CONTINUES[data], out=solid[1:])
        self.word_chars = np.diff(solid[at])
        self.n_symbols = np.diff(self._sums(SYMBOL[data])[at])
        hashes = word_hashes(data, starts, ends)
        self.n_repeat = self._repeats(hashes, first, n)
        self._lines(data, at, starts, ends, first, hashes)

    @staticmethod
    def _sums(flags: np.ndarray) -> np.ndarray:
        out = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=out[1:])
        return out

    @staticmethod
    def _repeats(hashes: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
        begin, _ = window_starts(first, WINDOW)
        keys = WORDS.windows(WORDS.prefix(hashes), WINDOW)[begin]
        owner = np.searchsorted(first, begin, "right") - 1
        keys = scramble(keys) ^ scramble(owner.astype(np.uint64))
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        # Equal keys are only candidates: the words of neighbours in a run decide.
        at = np.flatnonzero(same)
        a, b = order[1:][at], order[:-1][at]
        equal = owner[a] == owner[b]
        for k in range(WINDOW):
            equal &= hashes[begin[a] + k] == hashes[begin[b] + k]
        same[at] = equal
        twice = np.zeros(len(begin), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        cover = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(cover, begin[twice], 1)
        np.subtract.at(cover, begin[twice] + WINDOW, 1)
        return np.diff(Measures._sums(np.cumsum(cover)[:-1] > 0)[first])

    def _lines(self, data, at, starts, ends, first, hashes) -> None:
        n = len(at) - 1
        breaks = np.flatnonzero(data == 10)
        owner = np.searchsorted(at, breaks, "right") - 1
        self.n_lines = np.bincount(owner, minlength=n) + 1
        self.line_at = np.concatenate([[0], np.cumsum(self.n_lines)])
        lo = np.empty(self.line_at[-1], np.int64)
        lo[self.line_at[:-1]] = at[:-1]
        after = np.ones(len(lo), bool)
        after[self.line_at[:-1]] = False
        lo[after] = breaks + 1
        hi = np.empty(len(lo), np.int64)
        hi[self.line_at[1:] - 1] = at[1:]
        ended = np.ones(len(lo), bool)
        ended[self.line_at[1:] - 1] = False
        hi[ended] = breaks
        self.lo, self.hi = lo, hi
        w0, w1 = np.searchsorted(starts, lo), np.searchsorted(starts, hi)
        words = w1 - w0
        self.line_words = words
        raw = data.tobytes()
        repeated = np.zeros(len(lo), bool)
        for i in range(n):
            a, b = self.line_at[i], self.line_at[i + 1]
            if b - a > 1:
                seen = set()
                for k in range(a, b):
                    if words[k]:
                        line = raw[lo[k] : hi[k]]
                        if line in seen:
                            repeated[k] = True
                        seen.add(line)
        self.n_dup_lines = np.diff(self._sums(repeated)[self.line_at])
        count = lambda table: (lambda s: s[hi] - s[lo])(self._sums(table[data]))
        upper, lower, some = count(UPPER), count(LOWER), np.maximum(words, 1)
        symbols, letters = count(SYMBOL), np.maximum(hi - lo, 1)
        length = count(~WHITE) / some
        # Words equal to the word before or two before it in the line.
        again = np.zeros(len(hashes) + 1, bool)
        for k in (1, 2):
            again[k : len(hashes)] |= hashes[k:] == hashes[: max(len(hashes) - k, 0)]
        again = self._sums(again[:-1])
        last = np.where(words > 0, ends[np.maximum(w1 - 1, 0)] - 1 if len(ends) else 0, 0)
        begins = np.where(words > 0, starts[np.minimum(w0, max(len(starts) - 1, 0))] if len(starts) else 0, 0)
        tail = data[last] if len(data) else np.zeros(len(lo), np.uint8)
        head = data[begins] if len(data) else np.zeros(len(lo), np.uint8)
        flags = [
            np.ones(len(lo), bool), words == 0, (words > 0) & (words < 3), (words >= 3) & (words < 8),
            (upper > 0.3 * (upper + lower)) & (words > 0), (upper > 0.7 * (upper + lower)) & (words > 0),
            symbols >= 0.1 * some, symbols >= 0.4 * some, count(PIPE) >= 0.2 * some, count(EXCLAIM) >= 0.4 * some,
            count(DIGIT) >= 0.2 * letters, count(MARKUP) >= 0.3 * some, SENTENCE[tail] & (words > 0), UPPER[head] & (words > 0),
            repeated, (again[w1] - again[w0]) >= 0.3 * some, (length < 3) & (words > 0), length > 11,
            count(COMMA) >= 0.05 * some, after == 0,
        ]
        # Shares of nothing are no evidence.
        for k in (6, 7, 8, 9, 10, 11, 15, 18):
            flags[k] = flags[k] & (words > 0)
        self.masks = sum(f.astype(np.int64) << k for k, f in enumerate(flags))


def viterbi(scores: list[float], move: list[list[float]]) -> list[int]:
    """The best labels (1: content) of a line sequence; of equally good ones, content."""
    (t00, t01), (t10, t11) = move
    zero, one, back = 0.0, scores[0], []
    for s in scores[1:]:
        from0, from1 = one + t10 > zero + t00, one + t11 >= zero + t01
        back.append((from0, from1))
        zero, one = (one + t10 if from0 else zero + t00), (one + t11 if from1 else zero + t01) + s
    label = int(one >= zero)
    out = [label]
    for step in reversed(back):
        label = int(step[label])
        out.append(label)
    return out[::-1]


def _marks(m: Measures, model: LineModel) -> np.ndarray:
    """Label of each line of the slice."""
    known, where = np.unique(m.masks, return_inverse=True)
    scores, move = model.scores(known)[where].tolist(), model.move.tolist()
    out: list[int] = []
    for a, b in zip(m.line_at[:-1].tolist(), m.line_at[1:].tolist(), strict=True):
        out += viterbi(scores[a:b], move)
    return np.array(out, np.int64)


RATED = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, content_share double, n_lines long, n_content_lines long"
)


def rate(docs: DataFrame, model: LineModel, keep_share: float = KEEP_SHARE) -> DataFrame:
    """One row per document: base counts, base rule, share of words in content lines and verdict.

    One pass over the texts without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            m = Measures(part)
            marks = _marks(m, model)
            sums = Measures._sums
            content = np.diff(sums(m.line_words * marks)[m.line_at])
            share = np.where(m.n_words > 0, content / np.maximum(m.n_words, 1), 0.0)
            failed = (m.n_words < MIN_WORDS) | (100 * m.n_repeat > MAX_REPEAT_PERCENT * m.n_words)
            columns = [
                part.rows.column("doc_id"), m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat, failed,
                ~failed & (share >= keep_share), share, m.n_lines, np.diff(sums(marks)[m.line_at]),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names)

    names = [c.split()[0] for c in RATED.split(", ")]
    return _keyed(docs).mapInArrow(run, RATED)


def content_text(docs: DataFrame, model: LineModel) -> DataFrame:
    """(doc_id, text) with the content lines only, in their order; a null text becomes empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            m = Measures(part)
            marks, raw = _marks(m, model), part.data.tobytes()
            texts = [
                b"\n".join(raw[m.lo[k] : m.hi[k]] for k in range(a, b) if marks[k]).decode()
                for a, b in zip(m.line_at[:-1], m.line_at[1:], strict=True)
            ]
            yield pa.RecordBatch.from_arrays([part.rows.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return _keyed(docs).mapInArrow(run, "doc_id long, text string")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, fit_bytes: int = FIT_BYTES) -> LineModel:
    """Fit the field on a bounded sample of labelled documents.

    The sample: of either kind the ``fit_docs`` labelled ids with the smallest hash, those of
    them whose text has at most ``fit_bytes`` bytes. Only line masks of these reach the driver.
    """
    known = (
        labels.where("doc_id is not null and quality in (0, 1)")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
        .where("low = high")
    )
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = [known.where(F.col("low") == k).orderBy(*order).limit(fit_docs) for k in (0, 1)]
    sample = picked[0].union(picked[1]).select("doc_id", F.col("low").alias("quality"))
    ids = sample.toArrow()  # at most 2 * fit_docs rows of two numbers
    small = F.broadcast(docs.sparkSession.createDataFrame(ids, "doc_id long, quality int"))
    texts = _keyed(docs).where(F.octet_length("text") <= fit_bytes).join(small, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            m = Measures(part)
            lines = pa.ListArray.from_arrays(pa.array(m.line_at, pa.int32()), pa.array(m.masks))
            yield pa.RecordBatch.from_arrays(
                [part.rows.column("doc_id"), part.rows.column("quality"), lines], ["doc_id", "quality", "masks"]
            )

    rows = texts.mapInArrow(run, "doc_id long, quality int, masks array<long>").toArrow().to_pylist()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["masks"]))[: 2 * fit_docs]
    return fit_lines([np.array(r["masks"]) for r in rows], [r["quality"] for r in rows])


def fit_lines(sequences: list[np.ndarray], quality: list[int], rounds: int = 2) -> LineModel:
    """Maximum likelihood with a penalty. Line labels start as their document's quality; then a
    line of a bad document that looks like content on its own is relabelled, and the fit repeated."""
    if len(set(quality)) < 2:
        return ALL_CONTENT
    longest = max(map(len, sequences))
    masks = np.zeros((len(sequences), longest), np.int64)
    real = np.zeros(masks.shape, bool)
    for i, s in enumerate(sequences):
        masks[i, : len(s)], real[i, : len(s)] = s, True
    bits = ((masks[..., None] >> np.arange(len(FEATURES))) & 1).astype(float) * real[..., None]
    bad = np.array(quality) == 0
    truth = np.where(bad[:, None], 0, 1) * np.ones_like(masks)
    # Both kinds weigh the same, however many lines they have.
    share = real[bad].sum() / real.sum()
    weight = np.where(bad, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))
    model = LineModel(np.zeros(len(FEATURES)))
    for step in range(rounds):
        model = _ascend(bits, real, truth, weight, model)
        if step + 1 < rounds:
            alone = bits @ model.emit > 0
            guess = np.where(bad[:, None] & alone, 1, truth)
            junk = ((guess == 0) & real).any(1)
            truth = np.where((bad & junk)[:, None], guess, truth)
    return model


def _ascend(bits, real, truth, weight, model, steps: int = 150, rate: float = 0.15, penalty: float = 0.01) -> LineModel:
    """Adam on the log likelihood of the label sequences, by forward and backward sums."""
    docs, longest, width = bits.shape
    emit, move = model.emit.copy(), model.move.copy()
    total = (weight * real.sum(1)).sum()
    flat = bits.reshape(-1, width)
    pairs = real[:, 1:] & real[:, :-1]
    seen_move = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            seen_move[a, b] = (weight[:, None] * (pairs & (truth[:, :-1] == a) & (truth[:, 1:] == b))).sum()
    seen_emit = ((weight[:, None] * truth * real).reshape(-1)) @ flat
    m1, m2 = np.zeros(width + 4), np.zeros(width + 4)
    for t in range(1, steps + 1):
        score = np.zeros((docs, longest, 2))
        score[..., 1] = (flat @ emit).reshape(docs, longest)
        ahead, behind = np.zeros_like(score), np.zeros_like(score)
        ahead[:, 0] = score[:, 0]
        for k in range(1, longest):
            step = np.logaddexp(ahead[:, k - 1, 0, None] + move[0], ahead[:, k - 1, 1, None] + move[1]) + score[:, k]
            ahead[:, k] = np.where(real[:, k, None], step, ahead[:, k - 1])
        for k in range(longest - 2, -1, -1):
            tail = behind[:, k + 1] + score[:, k + 1]
            step = np.logaddexp(move[:, 0] + tail[:, 0, None], move[:, 1] + tail[:, 1, None])
            behind[:, k] = np.where(real[:, k + 1, None], step, 0.0)
        norm = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        p1 = np.exp(ahead[..., 1] + behind[..., 1] - norm[:, None]) * real * weight[:, None]
        grad_emit = seen_emit - p1.reshape(-1) @ flat
        grad_move = np.zeros((2, 2))
        for a in (0, 1):
            for b in (0, 1):
                p = ahead[:, :-1, a] + move[a, b] + score[:, 1:, b] + behind[:, 1:, b] - norm[:, None]
                grad_move[a, b] = seen_move[a, b] - (np.exp(np.where(pairs, p, -np.inf)) * weight[:, None]).sum()
        grad = np.concatenate([grad_emit, grad_move.reshape(-1)]) / total
        grad -= penalty * np.concatenate([emit, move.reshape(-1)]) / 10
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        change = rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
        emit, move = emit + change[:width], move + change[width:].reshape(2, 2)
    return LineModel(emit, move)


def keep(docs: DataFrame, model: LineModel, keep_share: float = KEEP_SHARE) -> DataFrame:
    """The rows of ``docs`` that :func:`rate` keeps, all their columns as they are, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            m = Measures(part)
            content = np.diff(Measures._sums(m.line_words * _marks(m, model))[m.line_at])
            good = (m.n_words >= MIN_WORDS) & (100 * m.n_repeat <= MAX_REPEAT_PERCENT * m.n_words)
            good &= content >= keep_share * m.n_words
            yield part.rows.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
