"""Toxicity by weak supervision.

Lexicon and pattern voters look at every text. A generative label model, fitted to the
counts of all vote patterns, estimates how often each voter fires on either
class and which voters fire together (a tree of dependences in each class), and gives every
pattern its posterior. A linear classifier is trained on posterior labels, and scores.

Labels serve only to find words and stems for the lexicon voters and to say which class is
which in the label model, and only those of rows that are not held out. Cases: a null text is empty and scores like one; null or conflicting
labels are left out; without labels the fixed lexicon and the patterns vote alone, and
without any pattern that looks toxic every score is the floor. Rows are scored one by one,
so repeated rows score alike; a null doc_id is scored, never learned from, and not held out.
Extra columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlab.session import materialise

#: Insults that a lexicon knows without looking at any label.
LEXICON = frozenset(
    "idiot idiots moron morons stupid dumb scum trash loser losers pathetic worthless disgusting clown garbage "
    "filth vermin imbecile retard bastard freak creep ugly hate".split()
)
PREDICTED_FROM = 0.3
#: At most so many labelled rows of either class serve to find words and stems, and at most so
#: many rows of either side of the posterior to train the classifier; each of at most FIT_BYTES.
FIT_DOCS = 3000
TRAIN_DOCS = 3000
FIT_BYTES = 20_000
#: A word or stem is taken up if its rate in toxic rows exceeds that in clean ones by so many
#: standard errors, and it is this many times as frequent.
LEAST_Z = 6.0
LEAST_RATIO = 9.0
LEAST_ROWS = 5
#: The same for the classifier's features, which it weighs itself.
TRAIN_Z = 6.0
#: Voters for each of: whole words, stems, stems of two or more words of a text.
DEALT = (3, 4, 4)
STEMS = (4, 5, 6)
FEATURES = 1024
PENALTY = 5e-5
#: Weight of the labelled rows in the label model, against all rows.
ANCHOR = 1.0

_WORD = re.compile(r"[^\W\d_]+")
_SHOUT = re.compile(r"!{2,}")
_ADDRESS = re.compile(r"\b(?:you|your|du|dein|ihr|tu|toi|vous|tú|usted)\b(?: \w+){0,2} (?:are|is|bist|seid|es|êtes|eres)\b", re.IGNORECASE)

#: A feature is (length of the stem or 0 for a whole word, characters, words needed: 1 or 2).
Feature = tuple[int, str, int]


def present(words: set[str], known: dict[int, set[str]]) -> Counter[tuple[int, str]]:
    """The known words and stems of a text, and in how many of its words each is."""
    found = Counter((0, w) for w in words & known.get(0, set()))
    for n in STEMS:
        some = known.get(n)
        if some:
            found.update((n, s) for w in words if (s := w[:n]) in some)
    return found


def _known(chosen) -> dict[int, set[str]]:
    by: dict[int, set[str]] = {}
    for n, s, _ in chosen:
        by.setdefault(n, set()).add(s)
    return by


@dataclass(frozen=True)
class Voters:
    """Numbered voters; each fires or not, so a document's votes are the bits of one number."""

    lists: list[frozenset[Feature]] = field(default_factory=list)

    def __post_init__(self) -> None:
        object.__setattr__(self, "known", _known(f for group in self.lists for f in group))
        object.__setattr__(self, "voter", {f: k for k, group in enumerate(self.lists) for f in group})

    @property
    def n(self) -> int:
        return len(self.lists) + 4

    def votes(self, text: str) -> int:
        words = set(_WORD.findall(text.lower()))
        fires = [False] * len(self.lists)
        for (n, s), times in present(words, self.known).items():
            for k in (1, 2):
                if times >= k and (n, s, k) in self.voter:
                    fires[self.voter[n, s, k]] = True
        lexical = words & LEXICON
        fires += [bool(lexical), len(lexical) > 1, bool(_SHOUT.search(text)), bool(_ADDRESS.search(text))]
        return sum(1 << k for k, f in enumerate(fires) if f)


def telling(rows: DataFrame, ratio: float, least_z: float = LEAST_Z) -> list[Feature]:
    """Features that rows with a value from 0.5 on have far more often than chance allows, the most telling first.

    ``rows`` (value, words) is a bounded sample without copies. Its words and stems are counted by Spark;
    only features that pass the row and ratio limits come to the driver.
    """
    side = (F.col("value") >= 0.5).cast("int")
    sizes = {r.side: r.n for r in rows.groupBy(side.alias("side")).agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1:
        return []
    n0 = max(n0, 1)
    # Numbered before the explosion: beside it, every word would get a number of its own.
    numbered = rows.withColumn("doc", F.monotonically_increasing_id())
    named = numbered.select("doc", side.alias("side"), F.explode("words").alias("w"))
    stems = [F.when(F.length("w") >= n, F.struct(F.lit(n).alias("n"), F.substring("w", 1, n).alias("s"))) for n in STEMS]
    parts = F.array_compact(F.array(F.struct(F.lit(0).alias("n"), F.col("w").alias("s")), *stems))
    each = named.select("doc", "side", F.explode(parts).alias("f")).groupBy("doc", "side", "f").agg(F.count("*").alias("times"))
    counts = []
    for k in (1, 2):
        has = F.col("times") >= k
        counts += [F.sum((has & (F.col("side") == y)).cast("int")).alias(f"c{k}{y}") for y in (0, 1)]
    found = each.groupBy("f").agg(*counts)
    often = [(F.col(f"c{k}1") >= LEAST_ROWS) & (F.col(f"c{k}1") / n1 >= ratio * (F.col(f"c{k}0") + 0.5) / n0) for k in (1, 2)]
    good = []
    for r in found.where(often[0] | often[1]).select("f.n", "f.s", "c11", "c10", "c21", "c20").collect():
        for k, toxic, clean in ((1, r.c11, r.c10), (2, r.c21, r.c20)):
            p1, p0 = toxic / n1, (clean + 0.5) / n0
            p = min((toxic + clean + 0.5) / (n1 + n0), 0.999)
            z = (p1 - p0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
            if toxic >= LEAST_ROWS and z >= least_z and p1 >= ratio * p0:
                good.append((-z, (r.n, r.s, k)))
    return [f for _, f in sorted(good)]


def induce(rows: DataFrame) -> Voters:
    """Lexicon voters from labelled rows: words and stems of toxic ones, dealt over voters."""
    good = telling(rows, LEAST_RATIO)
    kinds = [[f for f in good if f[0] == 0 and f[2] == 1], [f for f in good if f[0] and f[2] == 1], [f for f in good if f[0] and f[2] == 2]]
    return Voters([frozenset(kind[k::n]) for kind, n in zip(kinds, DEALT, strict=True) for k in range(n)])


class LabelModel:
    """A mixture of two classes; in each, voters depend on one another along a tree.

    Fitted by expectation maximisation to the pattern counts of all rows. ``accuracy[y, j]`` is
    how often voter j fires on class y; ``parent[j]`` and ``given[y, a, j]`` (firing where the
    parent's vote is a) hold the correlations. ``known`` are (pattern, class, weight) of labelled
    rows, whose class stays fixed, so that the classes keep their meaning; it may be empty.
    """

    def __init__(
        self, patterns: np.ndarray, counts: np.ndarray, n: int, start: np.ndarray, known: list[tuple[int, int, float]] = (), rounds: int = 40
    ):
        fixed = np.array([y for _, y, _ in known], float)
        both = np.concatenate([patterns, np.array([p for p, _, _ in known], np.int64)])
        votes = ((both[:, None] >> np.arange(n)) & 1).astype(float)
        weights = np.concatenate([counts.astype(float), [w for _, _, w in known]])
        self.n = n
        posterior = start
        if len(known):
            self._maximise(votes, np.where(np.arange(len(both)) < len(patterns), 0.0, weights), np.concatenate([start * 0, fixed]))
            posterior = self.posterior(patterns)
        for _ in range(rounds):
            self._maximise(votes, weights, np.concatenate([posterior, fixed]))
            posterior = self.posterior(patterns)

    def _maximise(self, votes: np.ndarray, counts: np.ndarray, posterior: np.ndarray) -> None:
        n, smooth = self.n, 0.5
        self.prior = float(np.clip((counts * posterior).sum() / counts.sum(), 1e-4, 1 - 1e-4))
        self.accuracy = np.empty((2, n))
        both = np.empty((2, n, n))
        information = np.zeros((n, n))
        for y, weight in enumerate((counts * (1 - posterior), counts * posterior)):
            total = weight.sum() + 2 * smooth
            one = weight @ votes + smooth
            self.accuracy[y] = one / total
            together = votes.T @ (weight[:, None] * votes)
            both[y] = together
            p11 = (together + smooth / 2) / total
            p1 = one / total
            for a in (0, 1):
                for b in (0, 1):
                    pa_, pb = (p1 if a else 1 - p1), (p1 if b else 1 - p1)
                    joint = p11 if a and b else p1[:, None] - p11 if a else p1[None, :] - p11 if b else 1 - p1[:, None] - p1[None, :] + p11
                    joint = np.maximum(joint, 1e-12)
                    information += (total / counts.sum()) * joint * np.log(joint / (pa_[:, None] * pb[None, :]))
        # The tree with the most mutual information, grown from voter 0.
        self.parent = np.full(n, -1)
        inside, best, link = np.zeros(n, bool), information[0].copy(), np.zeros(n, np.int64)
        inside[0] = True
        for _ in range(n - 1):
            j = int(np.argmax(np.where(inside, -np.inf, best)))
            self.parent[j], inside[j] = link[j], True
            closer = information[j] > best
            best, link = np.where(closer, information[j], best), np.where(closer, j, link)
        self.given = np.empty((2, 2, n))
        for y, weight in enumerate((counts * (1 - posterior), counts * posterior)):
            total = weight.sum()
            one = weight @ votes
            for j in range(n):
                p = self.parent[j]
                if p < 0:
                    self.given[y, :, j] = self.accuracy[y, j]
                else:
                    self.given[y, 1, j] = (both[y][p, j] + smooth) / (one[p] + 2 * smooth)
                    self.given[y, 0, j] = (one[j] - both[y][p, j] + smooth) / (total - one[p] + 2 * smooth)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """P(toxic | votes) of each pattern."""
        votes = (patterns[:, None] >> np.arange(self.n)) & 1
        log = np.tile(np.log([1 - self.prior, self.prior]), (len(patterns), 1))
        for j in range(self.n):
            above = votes[:, self.parent[j]] if self.parent[j] >= 0 else np.zeros(len(patterns), np.int64)
            for y in (0, 1):
                p = self.given[y][above, j]
                log[:, y] += np.log(np.where(votes[:, j] == 1, p, 1 - p))
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))


@dataclass
class Linear:
    """Presence of known words and stems, weighted and summed."""

    weights: dict[Feature, float]
    bias: float

    def __post_init__(self) -> None:
        self.known = _known(self.weights)

    def score(self, text: str) -> float:
        found = present(set(_WORD.findall(text.lower())), self.known)
        hits = [self.weights.get((n, s, k), 0.0) for (n, s), times in sorted(found.items()) for k in (1, 2) if times >= k]
        return float(1 / (1 + np.exp(-np.clip(self.bias + sum(hits), -30, 30))))


#: Scores where there is nothing to learn from.
FLOOR = Linear({}, float(np.log(0.01 / 0.99)))


def train(rows: DataFrame, mass: tuple[float, float], steps: int = 600) -> Linear:
    """Logistic regression on soft labels; ``mass`` is what the rows under and from 0.5 stand for.

    ``rows`` (value, words) is a bounded sample; to the driver come, of each row, its value and
    the places of the chosen features.
    """
    chosen = telling(rows, 3.0, TRAIN_Z)[:FEATURES]
    if not chosen:
        return FLOOR
    place, known = {f: i for i, f in enumerate(chosen)}, _known(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = []
            for words in batch.column("words").to_pylist():
                found = present(set(words), known)
                hits.append(sorted(place[n, s, k] for (n, s), times in found.items() for k in (1, 2) if times >= k and (n, s, k) in place))
            yield pa.RecordBatch.from_arrays([batch.column("value"), pa.array(hits, pa.list_(pa.int32()))], ["value", "hits"])

    sample = rows.mapInArrow(run, "value double, hits array<int>").toArrow().to_pylist()
    sample.sort(key=lambda r: (r["value"], r["hits"]))
    high = np.array([r["value"] >= 0.5 for r in sample])
    if high.all():
        return FLOOR
    rate1, rate0 = float(high.sum()), float((~high).sum())
    x = np.zeros((len(sample), len(chosen)), np.float32)
    for i, r in enumerate(sample):
        x[i, r["hits"]] = 1
    y = np.array([r["value"] for r in sample], np.float32)
    # Both sides count, the rarer one at least a quarter.
    share = np.clip(mass[1] / max(sum(mass), 1e-9), 0.25, 0.75)
    weight = np.where(high, share / rate1, (1 - share) / rate0).astype(np.float32)
    w, b = np.zeros(len(chosen), np.float32), 0.0
    m1, m2 = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        error = (weight * (y - p)).astype(np.float32)
        grad = np.concatenate([x.T @ error - PENALTY * w, [error.sum()]])
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        step = 0.05 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
        # Only evidence for toxicity counts: what is absent from toxic rows does not clear a text.
        w, b = np.maximum(w + step[:-1], 0).astype(np.float32), b + step[-1]
    return Linear({f: float(v) for f, v in zip(chosen, w, strict=True) if v}, float(b))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _sampled(docs: DataFrame, sample: DataFrame, once: bool) -> DataFrame:
    """(value, words) of the sampled rows (doc_id, value), whose number and text sizes are bounded; written.

    With ``once`` copies of a text count as one row.
    """
    ids = F.broadcast(docs.sparkSession.createDataFrame(sample.toArrow(), "doc_id long, value double"))
    texts = _keyed(docs).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= FIT_BYTES).join(ids, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [sorted(set(_WORD.findall((t.as_py() or "").lower()))) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("value"), pa.array(words, pa.list_(pa.string()))], ["value", "words"])

    rows = texts.mapInArrow(run, "value double, words array<string>")
    if not once:
        return materialise(rows, "sample")
    return materialise(rows.groupBy("words").agg(F.max("value").alias("value")).select("value", "words"), "sample")


def _voted(docs: DataFrame, voters: Voters) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes = [voters.votes(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(votes, pa.int64())], ["doc_id", "votes"])

    return _keyed(docs).mapInArrow(run, "doc_id long, votes long")


def _hashed(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows with the smallest hash of their id."""
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, train_docs: int = TRAIN_DOCS) -> tuple[Voters, LabelModel | None, Linear]:
    """Voters, label model and classifier. To the driver come two bounded samples and the counts
    of vote patterns, of which there are at most 2 to the number of voters (15)."""
    known = (
        labels.where("doc_id is not null and toxic in (0, 1)")
        .select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
        .where(~held_out())
        .groupBy("doc_id")
        .agg(F.min("toxic").alias("low"), F.max("toxic").alias("high"))
        .where("low = high")
        .select("doc_id", F.col("low").cast("double").alias("value"))
    )
    sample = _hashed(known.where("value = 0"), fit_docs).union(_hashed(known.where("value = 1"), fit_docs))
    voters = induce(_sampled(docs, sample, once=True))
    voted = materialise(_voted(docs, voters), "votes")
    table = sorted((r.votes, r.n) for r in voted.groupBy("votes").agg(F.count("*").alias("n")).collect())
    if not table:
        return voters, None, FLOOR
    patterns, counts = (np.array(c, np.int64) for c in zip(*table, strict=True))
    # To start with, a pattern is as likely toxic as lexicon voters fire in it.
    lexical = len(voters.lists) + 2
    firing = sum((patterns >> k) & 1 for k in range(lexical))
    rates = {r.label: r.n for r in known.groupBy(F.col("value").cast("int").alias("label")).agg(F.count("*").alias("n")).collect()}
    ids = F.broadcast(docs.sparkSession.createDataFrame(sample.toArrow(), "doc_id long, value double"))
    anchored = [(r.votes, int(r.value), r.n) for r in voted.join(ids, "doc_id").groupBy("votes", "value").agg(F.count("*").alias("n")).collect()]
    # Labelled rows weigh as much as all others, either class by its share of the labels.
    size = {y: sum(n for _, label, n in anchored if label == y) for y in rates}
    weigh = {y: ANCHOR * counts.sum() * n / sum(rates.values()) / max(size[y], 1) for y, n in rates.items()}
    anchored = sorted((v, y, n * weigh[y]) for v, y, n in anchored) if len(rates) == 2 else []
    model = LabelModel(patterns, counts, voters.n, np.array([0.02, 0.5, 0.9])[np.minimum(firing, 2)], anchored)
    posterior = model.posterior(patterns)
    toxic = [int(p) for p, q in zip(patterns, posterior, strict=True) if q >= 0.5]
    open_rows = voted.where(F.col("doc_id").isNotNull() & ~held_out())
    is_toxic = F.col("votes").isin(toxic)
    picked = _hashed(open_rows.where(is_toxic), train_docs).union(_hashed(open_rows.where(~is_toxic), train_docs))
    chance = dict(zip(patterns.tolist(), posterior.tolist(), strict=True))
    spark = docs.sparkSession
    soft = spark.createDataFrame([(r.doc_id, float(chance[r.votes])) for r in picked.collect()], "doc_id long, value double")
    mass = (float(counts[posterior < 0.5].sum()), float(counts[posterior >= 0.5].sum()))
    return voters, model, train(_sampled(docs, soft.groupBy("doc_id").agg(F.avg("value").alias("value")), once=False), mass)


def score(docs: DataFrame, classifier: Linear) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [classifier.score(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = _keyed(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= PREDICTED_FROM).cast("int").alias("predicted"))
