"""Reproducible sampling, exact splitting and row numbering.

Random draws follow a seeded hash of a unique integer key (`cells.hash_order`). Its
leading hex digits cut the order into up to 65,536 near-equal, gap-free ranges, whatever
the distribution of the keys. A count per range is all it takes to know where any rank
lies, so no step sorts or numbers the whole table, or a whole class, in one task.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable, Mapping, Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlab import fixed
from flowlab.functions.cells import hash_order
from flowlab.session import materialise, settle

RANGE_DIGITS = 4
# Counting per class: 4,096 ranges, each cut again if it holds more rows than this.
CAP_DIGITS = 3
SPLIT_ROWS = 1_000_000
SALTS = 64


def _with_order(df: DataFrame, key: str, seed: int) -> DataFrame:
    h = hash_order(F.col(key), seed)
    return df.withColumn("_h", h).withColumn("_range", F.substring("_h", 1, RANGE_DIGITS))


def global_rank(
    df: DataFrame, key: str, seed: int = fixed.SEED, target: str = "rank"
) -> DataFrame:
    """Number all rows 1..n in hash order of a unique key.

    Rows are numbered within their hash range and shifted by the size of the ranges
    before it. The shifts, at most 65,536 rows, are broadcast.
    """
    ordered = _with_order(df, key, seed)
    sizes = ordered.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(
        "_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift")
    )
    within = F.row_number().over(Window.partitionBy("_range").orderBy("_h", key))
    numbered = ordered.withColumn("_within", within)
    return (
        numbered.join(F.broadcast(shifts), "_range")
        .withColumn(target, F.col("_within") + F.col("_shift"))
        .drop("_h", "_range", "_within", "_shift")
    )


def number_sorted(df: DataFrame, order: Sequence[Column], target: str = "number") -> DataFrame:
    """Number all rows 1..n along any sort order, by a distributed sort.

    The sorted table is written with its partition-wise ids before they are counted, so
    that the ids counted are the ids shifted.
    """
    spot = F.monotonically_increasing_id()
    written = materialise(df.orderBy(*order).withColumn("_spot", spot), "sorted")
    part = F.shiftright("_spot", 33)
    sizes = written.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = settle(
        sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))
    )
    within = F.col("_spot").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        written.withColumn("_part", part)
        .join(shifts, "_part")
        .withColumn(target, within + F.col("_shift") + 1)
        .drop("_spot", "_part", "_shift")
    )


def hash_cuts(
    df: DataFrame,
    key: str,
    ranks_of: Callable[[int], Sequence[int]],
    seed: int = fixed.SEED,
) -> list[tuple[str, int] | None]:
    """The (hash, key) found at each rank of the hash order; None for rank 0.

    ``ranks_of`` turns the row count into the wanted ranks. Reads the key column twice:
    once for the range sizes (at most 65,536 rows, which also give the count), once for
    the few ranges that hold a wanted rank.
    """
    ordered = _with_order(df.select(key), key, seed)
    sizes = sorted(ordered.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect())
    ranks = ranks_of(sum(n for _, n in sizes))
    reached = list(accumulate(n for _, n in sizes))
    wanted: dict[tuple[str, int], int] = {}
    for rank in set(ranks) - {0}:
        at = bisect_left(reached, rank)
        prefix, n = sizes[at]
        wanted[(prefix, rank - (reached[at] - n))] = rank
    if not wanted:
        return [None for _ in ranks]
    deepest = max(offset for _, offset in wanted)
    place = F.row_number().over(Window.partitionBy("_range").orderBy("_h", key))
    near = (
        ordered.filter(F.col("_range").isin(*{prefix for prefix, _ in wanted}))
        .withColumn("_place", place)
        .filter(F.col("_place") <= deepest)
        .filter(
            F.struct("_range", "_place").isin(
                *[F.struct(F.lit(p), F.lit(o)) for p, o in wanted]
            )
        )
    )
    found = {wanted[(r["_range"], r["_place"])]: (r["_h"], r[key]) for r in near.collect()}
    return [found.get(rank) for rank in ranks]


def _after(key: str, seed: int, cut: tuple[str, int] | None) -> Column:
    """Whether a row lies beyond a cut in hash order."""
    if cut is None:
        return F.lit(True)
    h, k = hash_order(F.col(key), seed), F.col(key)
    return (h > cut[0]) | ((h == cut[0]) & (k > cut[1]))


def split_exact(
    df: DataFrame,
    key: str,
    fraction: float = fixed.TASK2_FRACTION,
    seed: int = fixed.SEED,
    target: str = "part",
) -> DataFrame:
    """Mark exactly ceil(fraction * n) random rows 2 and the others 1.

    Once the cut is known the mark is an expression on the key: the rows do not move.
    """
    (cut,) = hash_cuts(df, key, lambda n: [n - math.ceil(fraction * n)], seed)
    return df.withColumn(target, F.when(_after(key, seed, cut), 2).otherwise(1))


def hold_out(df: DataFrame, key: str, mode: str, seed: int = fixed.SEED) -> DataFrame:
    """`split_exact` with the hold-out share that belongs to a mode."""
    return split_exact(df, key, fixed.HOLDOUT_FRACTION[fixed.check_mode(mode)], seed)


def client_partition(
    df: DataFrame,
    key: str,
    clients: int = fixed.CLIENTS,
    seed: int = fixed.SEED,
    target: str = "client",
) -> DataFrame:
    """Deal the rows at random to clients in equal chunks; the last takes the remainder."""
    cuts = hash_cuts(df, key, lambda n: [n // clients * i for i in range(1, clients)], seed)
    if not cuts or cuts[0] is None:
        # Fewer rows than clients: all cuts lie before the first row.
        return df.withColumn(target, F.lit(clients - 1))
    # The cuts ascend, so those passed are a prefix: halve the range, comparing (hash, key).
    known = F.array(*[F.struct(F.lit(h).alias("h"), F.lit(k).alias("k")) for h, k in cuts])
    own = F.struct(hash_order(F.col(key), seed).alias("h"), F.col(key).alias("k"))
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])
    halve = lambda at, step: F.when(
        (at + step <= len(cuts)) & (F.get(known, at + step - 1) < own), at + step
    ).otherwise(at)
    return df.withColumn(target, F.aggregate(steps, F.lit(0), halve))


def shuffle_rows(df: DataFrame, key: str, seed: int = fixed.SEED) -> DataFrame:
    return df.orderBy(hash_order(F.col(key), seed), F.col(key))


def batch_number(
    df: DataFrame,
    key: str,
    size: int = fixed.BATCH_SIZE,
    seed: int = fixed.SEED,
    target: str = "batch",
) -> DataFrame:
    """Shuffled mini-batches of exactly ``size`` rows, the last one shorter."""
    ranked = global_rank(df, key, seed, "_rank")
    number = F.floor((F.col("_rank") - 1) / size).cast("long")
    return ranked.withColumn(target, number).drop("_rank")


def _cut_ranges(rows: DataFrame, label: str, limit: Column, digits: int) -> DataFrame:
    """Per class that exceeds its limit: the hash range the limit falls in.

    ``rows`` holds ``_h`` and, in ``_before``, how many rows of the class precede these.
    """
    sizes = rows.groupBy(label, F.substring("_h", 1, digits).alias("_range")).agg(
        F.count(F.lit(1)).alias("_size"), F.max("_before").alias("_before")
    )
    along = Window.partitionBy(label).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    running = F.sum("_size").over(along) + F.col("_before")
    first = F.min(F.struct("_range", "_running", "_size"))
    return settle(
        sizes.withColumn("_running", running)
        .filter(F.col("_running") >= limit)
        .groupBy(F.col(label).alias("_class"))
        .agg(first.alias("_cut"))
        .select(
            "_class",
            F.col("_cut._range").alias("_last"),
            (F.col("_cut._running") - F.col("_cut._size")).alias("_before"),
            F.col("_cut._size").alias("_size"),
        )
    )


def class_cap(
    df: DataFrame,
    label: str,
    key: str,
    cap: int = fixed.CLASS_CAP,
    special: Mapping[int | str, int] | None = None,
    seed: int = fixed.SEED,
) -> DataFrame:
    """Keep at most ``cap`` random rows per class; ``special`` sets other caps by class.

    A first pass over label and key counts each class per hash range and tells in which
    range a class reaches its cap. If that range is itself large, a second count splits
    it. Rows before the cut range stay and rows after it go by a filter, without moving;
    only the cut ranges are ranked. A class under its cap is never sorted. If ``df`` is
    costly to compute, materialise it first.
    """
    special = dict(special or {})
    limit = F.lit(cap)
    for value, other in special.items():
        limit = F.when(F.col(label) == value, other).otherwise(limit)
    ordered = df.withColumn("_h", hash_order(F.col(key), seed))
    same_class = F.col(label).eqNullSafe(F.col("_class"))
    digits = CAP_DIGITS
    cuts = _cut_ranges(ordered.withColumn("_before", F.lit(0)), label, limit, digits)
    if (cuts.agg(F.max("_size")).first()[0] or 0) > SPLIT_ROWS:
        at_cut = same_class & (F.substring("_h", 1, digits) == F.col("_last"))
        digits *= 2
        cuts = _cut_ranges(ordered.join(cuts, at_cut), label, limit, digits)
    spot = F.substring("_h", 1, digits)
    marked = ordered.join(cuts.select("_class", "_last", F.col("_before").alias("_passed")), same_class, "left")
    before = marked.filter(F.col("_last").isNull() | (spot < F.col("_last")))
    place = F.row_number().over(Window.partitionBy(label).orderBy("_h", key)) + F.col("_passed")
    at_cut = marked.filter(spot == F.col("_last")).withColumn("_place", place).filter(F.col("_place") <= limit)
    return before.select(*df.columns).union(at_cut.select(*df.columns))


def balanced_classes(
    df: DataFrame,
    label: str,
    key: str,
    classes: Sequence = tuple(fixed.TWO_CLASSES),
    cap: int = fixed.ATTACK_CAP,
    seed: int = fixed.SEED,
) -> DataFrame:
    """The chosen classes only, each capped, in shuffled order."""
    chosen = df.filter(F.col(label).isin(*classes))
    return shuffle_rows(class_cap(chosen, label, key, cap, seed=seed), key, seed)


def top_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int
) -> DataFrame:
    """The first ``n`` rows of each group.

    Spark drops all but n rows per group within each map task. With very many tasks one
    group would still gather n rows from each, so a first window works on groups salted
    by task, and the second sees at most `SALTS` * n rows per group.
    """
    salt = F.pmod(F.spark_partition_id(), F.lit(SALTS))
    place = F.row_number()
    partial = (
        df.withColumn("_salt", salt)
        .withColumn("_place", place.over(Window.partitionBy(*group, "_salt").orderBy(*order)))
        .filter(F.col("_place") <= n)
        .drop("_salt", "_place")
    )
    final = place.over(Window.partitionBy(*group).orderBy(*order))
    return partial.withColumn("_place", final).filter(F.col("_place") <= n).drop("_place")


def replay_first(
    df: DataFrame,
    label: str,
    arrival: Sequence[str],
    n: int = fixed.REPLAY_PER_CLASS,
) -> DataFrame:
    """The replay buffer: the first rows of each class to arrive, never evicted."""
    return top_per_group(df, [label], [F.col(c) for c in arrival], n)


def replay_draw(
    buffer: DataFrame,
    label: str,
    key: str,
    batch: int = fixed.REPLAY_DRAW,
    classes: int | None = None,
    seed: int = fixed.SEED,
) -> DataFrame:
    """A class-balanced random draw: max(1, batch // classes) rows per class present."""
    k = classes if classes is not None else buffer.select(label).distinct().count()
    share = max(1, batch // max(k, 1))
    return top_per_group(buffer, [label], [hash_order(F.col(key), seed), F.col(key)], share)


def fifo_draw(
    df: DataFrame,
    arrival: Sequence[str],
    key: str,
    batch: int,
    capacity: int = fixed.FIFO_CAPACITY,
    seed: int = fixed.SEED,
) -> DataFrame:
    """A uniform draw from the newest ``capacity`` rows."""
    newest = df.orderBy(*[F.col(c).desc() for c in arrival]).limit(capacity)
    return newest.orderBy(hash_order(F.col(key), seed), F.col(key)).limit(batch)


def intake_guard(
    df: DataFrame, batch: str, position: str, rows: int = fixed.INTAKE_ROWS
) -> DataFrame:
    """The rows of each combined batch that are offered to the replay buffer."""
    return top_per_group(df, [batch], [F.col(position)], rows)
