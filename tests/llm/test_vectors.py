import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlab.llm import pstable as q
from flowlab.sources.tables import table


def brute(rows, threshold=0.98):
    """{vec_id: (n_links, component)} of distinct usable vectors."""
    live = {}
    for i, v, label in rows:
        good = i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        if good:
            live[i] = (np.array(v, float) / np.linalg.norm(v), label)
    up = {i: i for i in live}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    links = dict.fromkeys(live, 0)
    ids = sorted(live)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            (u, a), (v, b) = live[i], live[j]
            if a == b and len(u) == len(v) and u @ v >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (links[i], find(i)) if i in live else (0, i) for i in {r[0] for r in rows} if i is not None}


def got(df):
    return {r.vec_id: (r.n_links, r.component_id) for r in df.where("vec_id is not null").collect()}


def test_odd_vectors(spark):
    random = np.random.default_rng(1)
    base = random.normal(size=(30, 16))
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(base)]
    rows += [(100 + i, (base[i] * 3 + random.normal(size=16) * 0.05).tolist(), i % 2) for i in range(30)]
    rows += [(200, rows[0][1], 1), (201, rows[0][1], None), (202, None, 0), (203, [0.0] * 16, 0), (204, [None] + rows[0][1][1:], 0)]
    rows += [(205, [float("nan")] + rows[0][1][1:], 0), (206, [float("inf")] + rows[0][1][1:], 0), (207, rows[0][1][:8], 0), (208, [], 0)]
    rows += [rows[0], (None, rows[0][1], 0), (209, [-x for x in rows[0][1]], 0), (210, [1e30] * 16, 0), (211, [2e30] * 16, 0)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, node string, component int")
    result = q.near_vectors(df)
    assert got(result) == brute(rows)
    assert result.count() == len({r[0] for r in rows if r[0] is not None}) + 1
    assert {r.kept for r in result.where("vec_id is null").collect()} == {True}


def test_a_large_group_over_several_blocks(spark):
    random = np.random.default_rng(2)
    centre = random.normal(size=64)
    rows = [(i, (centre + random.normal(size=64) * 0.12 * (i % 3 + 0.2)).tolist(), 3) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    rows = [(r.vec_id, list(r.embedding), r.label) for r in df.collect()]
    result, expected = got(q.near_vectors(df)), brute(rows)
    found, there = sum(n for n, _ in result.values()), sum(n for n, _ in expected.values())
    assert found <= there and found >= 0.99 * there > 0


@pytest.mark.parametrize("threshold", [0.9, 0.98])
def test_recall_on_the_table(spark, data, threshold):
    df = table(spark, data, "embeddings")
    rows = [(r.vec_id, list(r.embedding), r.label) for r in df.collect()]
    found = sum(n for n, _ in got(q.near_vectors(df, threshold)).values())
    there = sum(n for n, _ in brute(rows, threshold).values())
    assert 0.9 * there <= found <= there


def test_no_vectors(spark):
    assert q.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def by_id(rows, threshold=0.98):
    """{vec_id: (n_links, component)} where a vec_id may stand on several vectors."""
    held = {}
    for i, v, label in rows:
        held.setdefault(i, []).append((np.array(v, float) / np.linalg.norm(v), label))
    near = {i: {j for j in held if j != i and any(a == b and u @ v >= threshold for u, a in held[i] for v, b in held[j])} for i in held}
    out = {}
    for i in held:
        seen, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        out[i] = len(near[i]), min(seen)
    return out


def test_repeated_ids_with_other_vectors_and_copies(spark):
    random = np.random.default_rng(3)
    base = random.normal(size=(8, 16))
    rows = [(i, base[i % 8].tolist(), 0) for i in range(40)]
    rows += [(100 + i, (base[i % 8] + random.normal(size=16) * 0.03).tolist(), 0) for i in range(24)]
    # Two near vectors, two unlike ones, one in another label, and two ids that share both of their vectors.
    rows += [(1, (base[1] * 1.001 + 0.001).tolist(), 0), (3, base[4].tolist(), 0), (7, base[7].tolist(), 5), (200, base[5].tolist(), 5)]
    rows += [(300, base[6].tolist(), 0), (300, base[2].tolist(), 0), (301, base[6].tolist(), 0), (301, base[2].tolist(), 0), (5, base[5].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert got(q.near_vectors(df)) == by_id(rows)
    assert got(q.near_vectors(df.repartition(1).orderBy(F.desc("vec_id")))) == by_id(rows)


def test_vectors_of_any_finite_size(spark):
    v = np.random.default_rng(5).normal(size=16)
    rows = [(1, v.tolist(), 0), (2, (v * 1e200).tolist(), 0), (3, (v * 1e-200).tolist(), 0), (4, (-v * 1e300).tolist(), 0), (5, [0.0, -0.0] * 8, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert got(q.near_vectors(df)) == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (0, 5)}


def test_copies_are_one_node(spark):
    rows = spark.range(20_000).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0), -0.0 * F.col("id")).alias("embedding"), F.lit(1).cast("long").alias("label"))
    nodes, own = q._nodes(q.usable(rows))
    assert nodes.count() == 1 and own.count() == 20_000
    result = q.near_vectors(rows)
    assert {(r.n_links, r.component_id) for r in result.collect()} == {(19_999, 0)} and result.where("kept").count() == 1
