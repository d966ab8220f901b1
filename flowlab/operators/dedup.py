"""Duplicate removal, leak removal between two sets, unions.

Grouping treats nulls as equal, as the removal rules require, and combines copies before
the shuffle, so a row repeated a billion times costs one record per task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def drop_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def dedup_features(df: DataFrame, drop: Sequence[str] = (), key: str | None = None) -> DataFrame:
    """One row per distinct combination of features.

    ``drop`` names identifier columns to leave out of the comparison. With ``key``, the
    smallest key of each group of copies is kept.
    """
    slim = df.drop(*drop)
    if key is None:
        return slim.dropDuplicates()
    features = [c for c in slim.columns if c != key]
    return slim.groupBy(*features).agg(F.min(key).alias(key)).select(*slim.columns)


def duplicate_count(df: DataFrame) -> DataFrame:
    """How many rows repeat an earlier row."""
    copies = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("copies"))
    return copies.agg(
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).cast("long").alias("duplicate_rows")
    )


def removal_report(df: DataFrame, drop: Sequence[str] = ()) -> DataFrame:
    """Rows before and after whole-row and feature deduplication.

    Copies are combined first, then distinct rows within their feature group: two
    shuffles, neither of which gathers a repeated row.
    """
    features = [c for c in df.columns if c not in drop]
    whole = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("copies"))
    per_feature = whole.groupBy(*features).agg(
        F.sum("copies").alias("rows"), F.count(F.lit(1)).alias("whole_rows")
    )
    return per_feature.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).cast("long").alias("rows_in"),
        F.coalesce(F.sum(F.col("rows") - F.col("whole_rows")), F.lit(0))
        .cast("long").alias("removed_whole"),
        F.coalesce(F.sum(F.col("whole_rows") - 1), F.lit(0)).cast("long").alias("removed_feature"),
        F.count(F.lit(1)).alias("rows_out"),
    )


def _common(victim: DataFrame, guard: DataFrame, on: Sequence[str] | None) -> tuple[list[str], dict[str, Column]]:
    """The columns to compare, each cast to the sides' common type."""
    columns = list(on) if on else [c for c in victim.columns if c in guard.columns]
    common = victim.select(*columns).limit(0).union(guard.select(*columns).limit(0)).schema
    return columns, {c: F.col(f"`{c}`").cast(f.dataType) for c, f in zip(columns, common.fields)}


def remove_leaks(victim: DataFrame, guard: DataFrame, on: Sequence[str] | None = None) -> DataFrame:
    """Drop the rows of ``victim`` that occur in ``guard``, nulls being equal.

    Columns are compared by value: where the sides' types differ, both are cast to their
    common type first. The guard is reduced to distinct rows. A 64-bit hash of the columns is the
    shuffle key and the columns themselves decide, so a wide row is sorted by one number
    and a collision does no harm. The victim side may be skewed: adaptive execution
    splits its oversized partitions, which an anti join allows.
    """
    columns, cast = _common(victim, guard, on)
    digest = F.xxhash64(*cast.values())
    seen = guard.select(*[v.alias(c) for c, v in cast.items()]).distinct().select(
        *[F.col(f"`{c}`").alias(f"_seen_{i}") for i, c in enumerate(columns)], digest.alias("_seen")
    )
    same = reduce(
        lambda a, b: a & b,
        [cast[c].eqNullSafe(F.col(f"_seen_{i}")) for i, c in enumerate(columns)],
        F.col("_digest") == F.col("_seen"),
    )
    return victim.withColumn("_digest", digest).join(seen, same, "left_anti").drop("_digest")


#: Bits of the leak filter: 16 MB, which holds 10 million distinct rows with 2 % false alarms.
FILTER_BITS = 1 << 27


def may_leak(victim: DataFrame, guard: DataFrame, on: Sequence[str] | None = None, bits: int = FILTER_BITS) -> DataFrame:
    """``victim`` with ``may_leak``: false only where the guard surely lacks the row.

    A Bloom filter of two hashes over the guard, as bitmaps of 32,768 bits that partial aggregation
    merges; the whole is at most ``bits`` bits, so it can be broadcast whatever the guard's size.
    """
    _, cast = _common(victim, guard, on)
    spots = [F.pmod(F.xxhash64(F.lit(i), *cast.values()), F.lit(bits)) + 1 for i in (0, 1)]
    blocks = guard.select(F.explode(F.array(*spots)).alias("spot")).groupBy(F.bitmap_bucket_number("spot").alias("_block"))
    blocks = blocks.agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("_bits"))
    out = victim
    for i, spot in enumerate(spots):
        block = blocks.select(F.col("_block").alias(f"_block_{i}"), F.col("_bits").alias(f"_bits_{i}"))
        out = out.withColumns({f"_block_{i}": F.bitmap_bucket_number(spot), f"_at_{i}": F.bitmap_bit_position(spot)})
        out = out.join(F.broadcast(block), f"_block_{i}", "left")
    held = [
        F.coalesce(F.expr(f"shiftright(cast(conv(hex(substring(_bits_{i}, cast(_at_{i} div 8 as int) + 1, 1)), 16, 10) as int), cast(_at_{i} % 8 as int)) & 1"), F.lit(0)) == 1
        for i in (0, 1)
    ]
    return out.withColumn("may_leak", held[0] & held[1]).select(*victim.columns, "may_leak")


def remove_leaks_filtered(
    victim: DataFrame, guard: DataFrame, on: Sequence[str] | None = None, bits: int = FILTER_BITS
) -> DataFrame:
    """`remove_leaks` for a victim with few leaks: only rows that pass the guard's filter are shuffled.

    The exact anti join decides about these, so false alarms cost time only. The victim is read twice.
    """
    columns, _ = _common(victim, guard, on)
    marked = may_leak(victim, guard, columns, bits)
    doubtful = marked.filter("may_leak").drop("may_leak")
    return marked.filter("not may_leak").drop("may_leak").union(remove_leaks(doubtful, guard, columns))


def dedup_pair(
    df: DataFrame,
    key: str,
    is_test: str,
    victim: str = "test",
    observation: Observation | None = None,
    gap: str | None = None,
) -> DataFrame:
    """Deduplicate a train set and a test set and remove the leaks between them at once.

    Both sets come as one table with a boolean ``is_test``. One grouping by the features
    finds, per distinct row, its smallest train key and its smallest test key; the row
    goes to the guard side if it occurs there, else to the victim side. So the three
    steps take one shuffle, whose copies are combined before it. With ``victim=None``
    no leak is removed.

    ``observation`` receives what is removed (`observed_counts` reads it) from the job that
    computes the result. ``gap`` names a column marking rows that `mark_gaps` emptied: they
    are counted and go.
    """
    features = [c for c in df.columns if c not in (key, is_test)]
    sides = {"train": ~F.col(is_test), "test": F.col(is_test)}
    first = {s: F.min(F.when(cond, F.col(key))).alias(f"_{s}") for s, cond in sides.items()}
    counts = [F.count(F.when(cond, 1)).alias(f"_n_{s}") for s, cond in sides.items()] if observation else []
    merged = df.groupBy(*features).agg(*first.values(), *counts)
    if observation:
        is_gap = F.col(gap) if gap else F.lit(False)
        metrics = []
        for side, other in (("train", "test"), ("test", "train")):
            n = F.col(f"_n_{side}")
            leak = ~is_gap & (n > 0) & (F.col(f"_n_{other}") > 0) if side == victim else F.lit(False)
            metrics += count_metrics(side, {
                "rows_in": n, "gaps": F.when(is_gap, n),
                "copies": F.when(~is_gap, F.greatest(n - 1, F.lit(0))), "leaks": F.when(leak, 1),
                "rows_out": F.when(~is_gap & ~leak & (n > 0), 1),
            })
        merged = merged.observe(observation, *metrics)
    if gap:
        merged, features = merged.filter(~F.col(gap)), [c for c in features if c != gap]
    if victim is None:
        kept = {s: F.col(f"_{s}") for s in sides}
    else:
        guard = "train" if victim == "test" else "test"
        kept = {
            guard: F.col(f"_{guard}"),
            victim: F.when(F.col(f"_{guard}").isNull(), F.col(f"_{victim}")),
        }
    pairs = F.array(
        *[
            F.struct(kept[s].alias(key), F.lit(s == "test").alias(is_test))
            for s in ("train", "test")
        ]
    )
    out = merged.select(*features, F.explode(pairs).alias("_kept"))
    return out.select(*features, f"_kept.{key}", f"_kept.{is_test}").filter(F.col(key).isNotNull())


def count_metrics(side: str, values: dict[str, Column]) -> list[Column]:
    """The sum of each value under ``name:side``, 0 for no rows."""
    return [F.coalesce(F.sum(v), F.lit(0)).cast("long").alias(f"{name}:{side}") for name, v in values.items()]


def observed_counts(observation: Observation) -> list[dict[str, int | str]]:
    """One row per set of what `count_metrics` observed, once the job has run."""
    rows: dict[str, dict[str, int | str]] = {s: {"split": s} for s in ("train", "test")}
    for name, value in observation.get.items():
        what, side = name.rsplit(":", 1)
        rows[side][what] = value
    return list(rows.values())


def mark_gaps(df: DataFrame, is_gap: Column, key: str, gap: str = "_gap") -> DataFrame:
    """``df`` with a flag for rows with gaps, whose cells but the key are emptied.

    So all of them are one row of a grouping, which combines them before the shuffle: they can be
    counted by the job that drops them.
    """
    marked = df.withColumn(gap, is_gap)
    return marked.select(key, *[F.when(~F.col(gap), F.col(f"`{c}`")).alias(c) for c in df.columns if c != key], gap)


def pair_report(df: DataFrame, key: str, is_test: str, victim: str = "test") -> DataFrame:
    """What `dedup_pair` removes, per set: rows in, copies, leaks, rows out.

    From the same grouping: a distinct row counts its copies on either side, and is a leak
    where the guard side has it too.
    """
    features = [c for c in df.columns if c not in (key, is_test)]
    test = F.col(is_test)
    merged = df.groupBy(*features).agg(
        F.count(F.when(~test, 1)).alias("n_train"), F.count(F.when(test, 1)).alias("n_test")
    )
    sides = []
    for side, other in (("train", "test"), ("test", "train")):
        n, there = F.col(f"n_{side}"), F.col(f"n_{side}") > 0
        leak = there & (F.col(f"n_{other}") > 0) if side == victim else F.lit(False)
        sides.append(F.struct(
            F.lit(side).alias("split"),
            n.alias("n"),
            F.greatest(n - 1, F.lit(0)).alias("copies"),
            leak.cast("long").alias("leaks"),
        ))
    sums = [F.coalesce(F.sum(f"s.{c}"), F.lit(0)).cast("long") for c in ("n", "copies", "leaks")]
    rows_in, copies, leaks = sums
    return merged.select(F.explode(F.array(*sides)).alias("s")).groupBy(F.col("s.split").alias("split")).agg(
        rows_in.alias("rows_in"), copies.alias("copies"), leaks.alias("leaks"), (rows_in - copies - leaks).alias("rows_out")
    )


def union_sets(train: DataFrame, test: DataFrame, split: str = "split") -> DataFrame:
    """Both sets in one table; the literal column says which set a row belongs to."""
    return train.withColumn(split, F.lit("train")).unionByName(
        test.withColumn(split, F.lit("test"))
    )


def take_set(df: DataFrame, which: str, split: str = "split") -> DataFrame:
    return df.filter(F.col(split) == which).drop(split)


def append_replay(new: DataFrame, replay: DataFrame) -> DataFrame:
    """New rows followed by replayed ones, told apart by ``replayed``."""
    return new.withColumn("replayed", F.lit(0)).unionByName(
        replay.withColumn("replayed", F.lit(1))
    )
