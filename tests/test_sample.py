import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from flowlab.operators import sample


def order(key, seed=42):
    return hashlib.md5(f"{key}:{seed}".encode()).hexdigest(), key


@pytest.fixture(scope="module")
def skewed(spark):
    """One class holds more than a third of the rows."""
    return spark.range(5000).select(
        "id", F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 9).cast("int").alias("label")
    )


def brute_cap(rows, cap, special=None):
    groups = defaultdict(list)
    for i, label in rows:
        groups[label].append(i)
    return {
        (i, label)
        for label, ids in groups.items()
        for i in sorted(ids, key=order)[: (special or {}).get(label, cap)]
    }


@pytest.mark.parametrize("cap,special", [(1, None), (50, None), (50, {0: 700}), (100_000, None), (0, None)])
@pytest.mark.parametrize("split_rows", [1_000_000, 1])
def test_class_cap(skewed, monkeypatch, cap, special, split_rows):
    monkeypatch.setattr(sample, "SPLIT_ROWS", split_rows)
    monkeypatch.setattr(sample, "CAP_DIGITS", 3 if split_rows > 1 else 1)
    rows = [tuple(r) for r in skewed.collect()]
    got = {tuple(r) for r in sample.class_cap(skewed, "label", "id", cap, special).collect()}
    assert got == brute_cap(rows, cap, special)


def test_class_cap_with_null_class(spark):
    df = spark.range(40).select("id", F.when(F.col("id") < 30, 1).alias("label"))
    got = sample.class_cap(df, "label", "id", 4).groupBy("label").count().collect()
    assert {r[0]: r[1] for r in got} == {1: 4, None: 4}


def test_draws_do_not_depend_on_partitioning(skewed):
    a = sample.class_cap(skewed, "label", "id", 20)
    b = sample.class_cap(skewed.repartition(13, "label"), "label", "id", 20)
    assert {r[0] for r in a.collect()} == {r[0] for r in b.collect()}


@pytest.mark.parametrize("n,fraction", [(1000, 0.8), (7, 0.3), (1, 0.5), (10, 1.0), (0, 0.5)])
def test_split_is_exact(spark, n, fraction):
    import math

    got = Counter(r["part"] for r in sample.split_exact(spark.range(n), "id", fraction).collect())
    assert got[2] == math.ceil(fraction * n) and got[1] == n - got[2]


def test_split_takes_the_first_of_the_order(spark):
    got = {r["id"] for r in sample.split_exact(spark.range(200), "id", 0.8).filter("part = 1").collect()}
    assert got == set(sorted(range(200), key=order)[:40])


@pytest.mark.parametrize("n,k", [(1000, 7), (10, 3), (3, 5), (5, 5), (5, 1)])
def test_clients(spark, n, k):
    got = {r["id"]: r["client"] for r in sample.client_partition(spark.range(n), "id", k).collect()}
    chunk = n // k
    for place, i in enumerate(sorted(range(n), key=order)):
        assert got[i] == (min(place // chunk, k - 1) if chunk else k - 1)


def test_global_rank_and_batches(spark):
    df = spark.range(1500)
    ranks = {r["id"]: r["rank"] for r in sample.global_rank(df, "id").collect()}
    assert ranks == {i: p for p, i in enumerate(sorted(range(1500), key=order), 1)}
    sizes = Counter(r["batch"] for r in sample.batch_number(df, "id").collect())
    assert sizes == {b: 64 for b in range(23)} | {23: 28}


def test_number_sorted(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("v")).repartition(9)
    got = {r["v"]: r["number"] for r in sample.number_sorted(df, [F.col("v")]).collect()}
    assert got == {v: v + 1 for v in range(1000)}


def test_top_per_group_over_many_tasks(skewed, monkeypatch):
    monkeypatch.setattr(sample, "SALTS", 4)
    got = {tuple(r) for r in sample.replay_first(skewed.repartition(40), "label", ["id"], 15).collect()}
    groups = defaultdict(list)
    for i, label in sorted(map(tuple, skewed.collect())):
        groups[label].append(i)
    assert got == {(i, label) for label, ids in groups.items() for i in ids[:15]}


@pytest.mark.parametrize("k,share", [(2, 8), (10, 1), (40, 1)])
def test_replay_draw_share(skewed, k, share):
    buffer = sample.replay_first(skewed, "label", ["id"])
    got = Counter(r["label"] for r in sample.replay_draw(buffer, "label", "id", 16, k).collect())
    assert set(got.values()) == {share}


def test_fifo_and_intake(spark):
    df = spark.range(300).select("id", (F.col("id") / 100).cast("int").alias("batch"))
    drawn = {r["id"] for r in sample.fifo_draw(df, ["id"], "id", 10, capacity=50).collect()}
    assert len(drawn) == 10 and min(drawn) >= 250
    taken = Counter(r["batch"] for r in sample.intake_guard(df, "batch", "id").collect())
    assert set(taken.values()) == {64}


def test_shuffle_is_a_permutation(spark):
    got = [r["id"] for r in sample.shuffle_rows(spark.range(100), "id").collect()]
    assert got == sorted(range(100), key=order)
