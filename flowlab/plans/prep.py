"""Preparing a train set and a test set together, end to end.

Every function takes both sets with a unique integer ``key`` and keeps that key, since
sampling and splitting need one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from flowlab import fixed
from flowlab.functions import cells
from flowlab.operators import clean, dedup, encode
from flowlab.operators.sample import balanced_classes, class_cap
from flowlab.session import materialise

Pair = tuple[DataFrame, DataFrame]
Counts = list[dict[str, int | str]]


def clean_flows(df: DataFrame, key: str = "id") -> DataFrame:
    """Offline cleaning of one set: gaps, unknown service, copies, label codes.

    Copies are told by the label as it was written, so two spellings of a label remain
    two rows.
    """
    rows = clean.drop_incomplete(clean.blanks_to_null(df))
    rows = rows.withColumn("service", cells.sentinel_to_token(F.col("service")))
    rows = dedup.dedup_features(rows, [c for c in fixed.DROP_OFFLINE if c != key], key)
    return clean.map_labels(rows, "attack_cat") if "attack_cat" in rows.columns else rows


def prepare_offline(
    train: DataFrame,
    test: DataFrame,
    cap: int = fixed.CLASS_CAP,
    special: Mapping[int, int] | None = None,
    key: str = "id",
    seed: int = fixed.SEED,
) -> Pair:
    """Clean both sets, drop test rows the train set has, and cap the classes.

    The cleaned pair is written once: the class counts and the cap read it.
    """
    return prepare_offline_counted(train, test, cap, special, key, seed)[0]


def prepare_offline_counted(
    train: DataFrame,
    test: DataFrame,
    cap: int = fixed.CLASS_CAP,
    special: Mapping[int, int] | None = None,
    key: str = "id",
    seed: int = fixed.SEED,
) -> tuple[Pair, Counts]:
    """`prepare_offline` and what it removed from each set.

    The rows are cleaned as in `clean_flows`. One grouping finds the copies in both sets; a second shuffle, of distinct rows
    only, brings the spellings of a label together to tell the leaks. The counters are metrics of
    that same job's last stage, so nothing is read again and a stage that is repeated counts once.
    """
    sides = []
    for df, is_test in ((train, False), (test, True)):
        rows = clean.blanks_to_null(df)
        rows = dedup.mark_gaps(rows, clean.is_incomplete(rows), key)
        rows = rows.withColumn("service", cells.sentinel_to_token(F.col("service")))
        rows = rows.withColumn("service", F.when(~F.col("_gap"), F.col("service")))
        sides.append(rows.drop(*[c for c in fixed.DROP_OFFLINE if c != key]).withColumn("_test", F.lit(is_test)))
    both = sides[0].unionByName(sides[1])
    apart = [c for c in both.columns if c != key]
    rows = both.groupBy(*apart).agg(F.min(key).alias(key), F.count(F.lit(1)).alias("_n"))
    labelled = F.lit(True)
    if "attack_cat" in apart:
        code = cells.label_code(cells.strip(F.col("attack_cat")), fixed.ATTACK_CODES)
        rows, labelled = rows.withColumn("new_label", code).drop("attack_cat"), F.col("new_label").isNotNull()
    features = [c for c in rows.columns if c not in (key, "_n", "_gap", "_test")]
    same = Window.partitionBy(F.xxhash64(*features), "_gap", *features)
    in_train = F.coalesce(F.max((~F.col("_test")).cast("int")).over(same), F.lit(0)) == 1
    rows = rows.withColumn("_leak", F.col("_test") & in_train & ~F.col("_gap") & labelled)
    kept = ~F.col("_gap") & labelled & ~F.col("_leak")
    metrics = []
    for side, here in (("train", ~F.col("_test")), ("test", F.col("_test"))):
        metrics += dedup.count_metrics(side, {
            "rows_in": F.when(here, F.col("_n")), "gaps": F.when(here & F.col("_gap"), F.col("_n")),
            "copies": F.when(here & ~F.col("_gap"), F.col("_n") - 1),
            "unlabelled": F.when(here & ~F.col("_gap") & ~labelled, 1), "leaks": F.when(here & F.col("_leak"), 1),
            **{f"class {c}": F.when(here & kept & (F.col("new_label") == c), 1) for c in fixed.ATTACK_CODES.values() if "new_label" in features},
        })
    seen = Observation()
    shown = [c for c in clean_columns(train, key) if c in rows.columns] + [c for c in ("new_label",) if c in features]
    pair = materialise(rows.observe(seen, *metrics).filter(kept).select(*dict.fromkeys(shown), "_test"), "pair")
    counts = dedup.observed_counts(seen)
    for row in counts:
        classes = {c: row.pop(f"class {c}") for c in fixed.ATTACK_CODES.values() if f"class {c}" in row}
        row["capped"] = sum(max(n - (special or {}).get(c, cap), 0) for c, n in classes.items())
        row["rows_out"] = sum(classes.values()) - row["capped"]
    capped = [
        class_cap(pair.filter(side).drop("_test"), "new_label", key, cap, special, seed) for side in ("not _test", "_test")
    ]
    return (capped[0], capped[1]), counts


def clean_columns(df: DataFrame, key: str) -> list[str]:
    """The columns that the offline cleaning keeps."""
    return [c for c in df.columns if c == key or c not in (*fixed.DROP_OFFLINE, "attack_cat")]


def prepare_offline_binary(train: DataFrame, test: DataFrame, key: str = "id") -> Pair:
    """`prepare_offline` with the larger cap for the normal class."""
    return prepare_offline(train, test, fixed.ATTACK_CAP, {0: fixed.NORMAL_CAP}, key)


def prepare_online(
    train: DataFrame,
    test: DataFrame,
    mode: str,
    key: str = "id",
    domain: str = "union",
    layout: str = "columns",
) -> Pair:
    """Cleaning, labels, one-hot, deduplication, leak removal from train, min-max.

    ``layout`` is that of `encode.one_hot_pair`; a sparse column holds ones only and is not scaled.

    Copies are removed before the one-hot expansion: the rows equal each other then just
    as they do after it, and the shuffle is narrower.
    """
    return prepare_online_counted(train, test, mode, key, domain, layout)[0]


def prepare_online_counted(
    train: DataFrame, test: DataFrame, mode: str, key: str = "id", domain: str = "union", layout: str = "columns"
) -> tuple[Pair, Counts]:
    """`prepare_online` and what it removed from each set, counted by the job that removes it."""
    fixed.check_mode(mode)

    def known(df: DataFrame) -> DataFrame:
        return df.withColumn("service", cells.sentinel_to_null(F.col("service")))

    def named(df: DataFrame) -> DataFrame:
        label = cells.strip(F.coalesce(F.col("attack_cat"), F.lit("Normal")))
        return df.withColumn("label", label)

    # Labels and categories come from the rows without gaps; the rows with gaps go on, emptied, to be counted.
    whole = [clean.drop_incomplete(known(t)) for t in (train, test)]
    marked = [dedup.mark_gaps(known(t), clean.is_incomplete(known(t)), key) for t in (train, test)]
    if mode == "binary":
        marked = [t.withColumn("label", cells.to_binary(F.col("label"))) for t in marked]
    else:
        encoder = encode.encode_labels(named(whole[0]), named(whole[1]), "label")[2]
        marked = [encoder.apply(named(t)) for t in marked]
    dropped = [c for c in fixed.DROP_ONLINE if c != key]
    train, test = (t.drop(*dropped) for t in marked)

    categories = [c for c in fixed.CATEGORICALS if c in train.columns]
    expand = encode.one_hot_like(categories, *(whole if domain == "union" else whole[:1]), layout=layout)
    both = dedup.union_sets(train, test).withColumn("is_test", F.col("split") == "test").drop("split")
    seen = Observation()
    pair = materialise(dedup.dedup_pair(both, key, "is_test", victim="train", observation=seen, gap="_gap"), "pair")
    train, test = pair.filter("not is_test").drop("is_test"), pair.filter("is_test").drop("is_test")
    train, test = expand(train), expand(test)
    features = [c for c in features_of(train, "label", key) if c != "onehot"]
    return encode.minmax_pair(train, test, features), dedup.observed_counts(seen)


def features_of(df: DataFrame, label: str, key: str) -> list[str]:
    return [c for c in df.columns if c not in (label, key)]


def _ordinals(train: DataFrame, test: DataFrame) -> Pair:
    return encode.ordinal_pair(
        train, test, [c for c in fixed.CATEGORICALS if c in train.columns]
    )


def _mode_label(df: DataFrame, mode: str, label: str) -> DataFrame:
    change = cells.to_binary if fixed.check_mode(mode) == "binary" else cells.merge_classes
    return df.withColumn(label, change(F.col(label)))


def _finish(train: DataFrame, test: DataFrame, label: str, key: str) -> Pair:
    train, test, _ = encode.encode_labels(train, test, label)
    return encode.standardise_pair(train, test, features_of(train, label, key))


def load_baseline(
    train: DataFrame, test: DataFrame, mode: str, label: str = "new_label", key: str = "id"
) -> Pair:
    """Prepared sets as model input: ordinal codes, mode labels, standardised."""
    train, test = _ordinals(train, test)
    return _finish(_mode_label(train, mode, label), _mode_label(test, mode, label), label, key)


def load_grouped(
    train: DataFrame, test: DataFrame, mode: str, label: str = "new_label", key: str = "id"
) -> Pair:
    """`load_baseline` with the features in a static and a dynamic vector."""
    return _grouped(*load_baseline(train, test, mode, label, key), label, key)


def _grouped(train: DataFrame, test: DataFrame, label: str, key: str) -> Pair:
    groups = clean.semantic_groups(features_of(train, label, key))
    keep = [key, label]
    return clean.group_columns(train, groups, keep), clean.group_columns(test, groups, keep)


def load_without_rare(
    train: DataFrame,
    test: DataFrame,
    label: str = "new_label",
    key: str = "id",
    classes: Sequence[int] = tuple(fixed.RARE_CLASSES),
) -> Pair:
    """The rare classes left out; domains come from the whole sets."""
    train, test = _ordinals(train, test)
    kept = [clean.remove_classes(t, label, classes) for t in (train, test)]
    return _grouped(*_finish(*kept, label, key), label, key)


def load_reordered(
    train: DataFrame, test: DataFrame, mode: str, label: str = "new_label", key: str = "id"
) -> Pair:
    """`load_baseline` with related features next to each other."""
    train, test = _ordinals(train, test)
    ordered = [_reordered(t, label, key) for t in (train, test)]
    return _finish(*[_mode_label(t, mode, label) for t in ordered], label, key)


def _reordered(df: DataFrame, label: str, key: str) -> DataFrame:
    names = clean.reorder_columns(df.drop(key), label).columns
    return df.select(key, *names)


def load_two_class(
    train: DataFrame,
    test: DataFrame,
    label: str = "new_label",
    key: str = "id",
    classes: Sequence[int] = tuple(fixed.TWO_CLASSES),
    cap: int = fixed.ATTACK_CAP,
    seed: int = fixed.SEED,
) -> Pair:
    """Two classes only, capped, codes and scale from the sample."""
    train, test = [
        materialise(balanced_classes(t, label, key, classes, cap, seed), "two-class")
        for t in (train, test)
    ]
    train, test = _ordinals(train, test)
    return _finish(_reordered(train, label, key), _reordered(test, label, key), label, key)
