import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlab import fixed, session
from flowlab.functions import cells
from flowlab.operators import clean, dedup, encode, sample
from flowlab.plans import prep
from flowlab.session import materialise, settle, small_or_none, work_dir
from flowlab.sources import flows as flow_files


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_blank_means_any_white_space(spark):
    df = spark.createDataFrame([("a",), ("",), (" \t\n",), (" ",), (None,)], "s string")
    assert [r[0] for r in df.select(cells.blank_to_null(F.col("s"))).collect()] == ["a", None, None, None, None]


def test_strip_removes_tabs(spark):
    df = spark.createDataFrame([("\t Fuzzers \n",), ("a b",)], "s string")
    assert [r[0] for r in df.select(cells.strip(F.col("s"))).collect()] == ["Fuzzers", "a b"]


def test_map_labels_drops_unknown(spark):
    df = spark.createDataFrame([("\tDoS ", 1), ("Other", 2), (None, 3)], "attack_cat string, v int")
    assert rows(clean.map_labels(df, "attack_cat")) == [(1, 4)]


def test_to_binary_of_null_is_attack(spark):
    df = spark.createDataFrame([(0,), (7,), (None,)], "l int")
    assert [r[0] for r in df.select(cells.to_binary(F.col("l"))).collect()] == [0, 1, 1]


def test_mode_is_checked():
    with pytest.raises(ValueError, match="binary"):
        flow_files.mode_path("x", "train", "both")


def test_dedup_is_idempotent_and_keeps_first_key(spark):
    df = spark.createDataFrame([(3, "a", None), (1, "a", None), (2, "b", 1)], "id int, s string, v int")
    once = dedup.dedup_features(df, key="id")
    assert rows(once) == [(1, "a", None), (2, "b", 1)]
    assert rows(dedup.dedup_features(once, key="id")) == rows(once)
    assert dedup.duplicate_count(df.drop("id")).first()[0] == 1


def test_leaks_are_null_safe_and_keep_copies(spark):
    victim = spark.createDataFrame([("a", None), ("a", None), ("b", 1), ("b", 1), ("c", None)], "s string, v int")
    guard = spark.createDataFrame([("a", None), ("c", 2)], "s string, v int")
    left = dedup.remove_leaks(victim, guard)
    assert sorted(r["s"] for r in left.collect()) == ["b", "b", "c"]
    assert dedup.remove_leaks(left, guard).count() == 3


@pytest.mark.parametrize("victim", ["test", "train", None])
def test_dedup_pair_equals_separate_steps(spark, victim):
    df = spark.range(600).select(
        F.col("id"), (F.col("id") % 7).alias("a"),
        F.when(F.col("id") % 11 < 9, F.col("id") % 5).alias("b"), (F.col("id") % 3 == 0).alias("is_test"),
    ).filter("a < 6 or is_test").filter("b is null or b < 4 or not is_test")
    train, test = [
        dedup.dedup_features(df.filter(s).drop("is_test"), key="id") for s in ("not is_test", "is_test")
    ]
    if victim == "test":
        test = dedup.remove_leaks(test, train, ["a", "b"])
    elif victim == "train":
        train = dedup.remove_leaks(train, test, ["a", "b"])
    pair = dedup.dedup_pair(df, "id", "is_test", victim)
    pick = lambda t: rows(t.select("id", F.coalesce("a", F.lit(-1)), F.coalesce("b", F.lit(-1))))
    assert pick(pair.filter("not is_test")) == pick(train)
    assert pick(pair.filter("is_test")) == pick(test)


def test_scaling_of_constant_column_and_no_clipping(spark):
    train = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, c double")
    test = spark.createDataFrame([(5.0, 6.0)], "x double, c double")
    a, b = encode.minmax_pair(train, test, ["x", "c"])
    assert rows(a) == [(0.0, 0.0), (1.0, 0.0)] and rows(b) == [(2.0, 1.0)]
    a, b = encode.standardise_pair(train, test, ["x", "c"])
    assert rows(a) == [(-1.0, 0.0), (1.0, 0.0)] and rows(b) == [(3.0, 1.0)]


def test_correlation_skips_constants_and_missing_pairs(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0, 1), (2.0, 2.0, 0), (None, 2.0, 1), (3.0, 2.0, 0)], "x double, c double, y int"
    )
    found = {r[0]: r[1] for r in encode.correlations(df, ["x", "c"], "y").collect()}
    assert found["c"] is None
    assert found["x"] == pytest.approx(-0.8660254037844387)
    assert [r[0] for r in encode.select_features(df, ["x", "c"], "y").collect()] == ["x"]


def test_one_hot_names_and_nulls(spark):
    train = spark.createDataFrame([(1, "b"), (2, None)], "id int, p string")
    test = spark.createDataFrame([(3, "a")], "id int, p string")
    a, b = encode.one_hot_pair(train, test, ["p"])
    assert a.columns == ["id", "p_a", "p_b"]
    assert rows(a) == [(1, 0, 1), (2, 0, 0)] and rows(b) == [(3, 1, 0)]
    a, _ = encode.one_hot_pair(train, test, ["p"], domain="train")
    assert a.columns == ["id", "p_b"]


def test_unseen_label_is_named(spark):
    train = spark.createDataFrame([(0,), (3,)], "y int")
    test = spark.createDataFrame([(3,), (8,)], "y int")
    with pytest.raises(ValueError, match="8"):
        encode.encode_labels(train, test, "y")
    a, b, _ = encode.encode_labels(train, test.filter("y = 3"), "y")
    assert rows(a) == [(0,), (1,)] and rows(b) == [(1,)]


@pytest.mark.parametrize("small", [10, 400, 100_000])
def test_ordinal_codes_on_every_size_path(spark, monkeypatch, small):
    monkeypatch.setattr(encode, "SMALL_ROWS", small)
    df = spark.range(1000).select(F.col("id"), F.concat(F.lit("v"), (F.col("id") * 7) % 300).alias("c"))
    codes = {v: i for i, v in enumerate(sorted(f"v{i}" for i in range(300)))}
    out = encode.OrdinalEncoder.fit("c", df).apply(df, "code")
    assert out.count() == 1000
    assert all(codes[r["c"]] == r["code"] for r in out.collect())
    other = spark.createDataFrame([("zz",), (None,)], "c string")
    assert [r["code"] for r in encode.OrdinalEncoder.fit("c", df).apply(other, "code").collect()] == [None, None]


def test_small_table_helpers(spark):
    df = spark.range(50)
    assert small_or_none(df, 10) is None and len(small_or_none(df, 50)) == 50
    assert settle(df, 10).count() == 50 and settle(df, 100).count() == 50
    assert rows(materialise(df)) == rows(df)
    assert work_dir(spark) == work_dir(spark)


def test_csv_missing_tokens(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,proto,dur\n1,tcp,0.5\n2,NA,\n3,"null",NaN\n4, ,1\n')

    schema = T.StructType([
        T.StructField("id", T.IntegerType()), T.StructField("proto", T.StringType()),
        T.StructField("dur", T.DoubleType()),
    ])
    got = {r["id"]: (r["proto"], r["dur"]) for r in flow_files.read_csv(spark, str(tmp_path / "t.csv"), schema).collect()}
    assert got[1] == ("tcp", 0.5) and got[2] == (None, None) and got[3] == (None, None)
    assert got[4][1] == 1.0


@pytest.mark.parametrize("text", [" padded\t", 'a "quoted" word', "comma, here", "back\\slash", "-"])
def test_csv_keeps_text_as_it_is(spark, tmp_path, text):
    df = spark.createDataFrame([(1, text), (2, None)], "id int, s string")
    flow_files.write_csv(df, str(tmp_path / "t"))
    assert rows(flow_files.read_csv(spark, str(tmp_path / "t"), df.schema)) == [(1, text), (2, None)]


def test_described_source(spark, tmp_path):
    (tmp_path / "d.csv").write_text("srcip,sport,dur\n10.0.0.1,80,0.25\n")
    (tmp_path / "f.csv").write_text("No.,Name,Type\n1,srcip,nominal\n2,sport,integer\n3,Dur,Float\n")
    df, features = flow_files.read_described(spark, str(tmp_path / "d.csv"), str(tmp_path / "f.csv"))
    assert df.dtypes == [("srcip", "string"), ("sport", "bigint"), ("dur", "double")]
    assert rows(df) == [("10.0.0.1", 80, 0.25)] and features.count() == 3


def test_missing_source_is_reported(spark, tmp_path):
    spark.range(1).write.parquet(str(tmp_path / "here"))
    assert flow_files.source_status(spark, str(tmp_path / "here")).first()["status"] == "found"
    assert flow_files.source_status(spark, str(tmp_path / "gone")).first()["status"] == "missing"


def test_vector_cutting(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0, 6.0],)], "v array<double>")
    assert clean.reshape(df, "v", 3).first()["x"] == [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]]
    with pytest.raises(Exception, match="not a multiple of 4"):
        clean.reshape(df, "v", 4).collect()


def test_gaf_is_symmetric_and_handles_constant_rows(spark):
    df = spark.createDataFrame([([0.0, 1.0, 4.0],), ([2.0, 2.0, 2.0],)], "v array<double>")
    first, flat = [r["image"] for r in encode.image(df, "v").collect()]
    for i in range(3):
        for j in range(3):
            assert first[i][j] == pytest.approx(first[j][i])
    assert first[0][0] == pytest.approx(1.0) and first[0][2] == pytest.approx(-1.0)
    assert flat == [[-1.0] * 3] * 3


def make_flows(spark, n, offset=0):
    values = {
        "id": F.col("id").cast("int"), "dur": F.col("id") % 9 / 2.0,
        "proto": F.element_at(F.array(F.lit("tcp"), F.lit("udp")), (F.col("id") % 2 + 1).cast("int")),
        "service": F.when(F.col("id") % 3 == 0, "-").otherwise("http"),
        "state": F.lit("FIN"),
        "attack_cat": F.element_at(
            F.array(*[F.lit(c) for c in fixed.ATTACK_CODES]), (F.col("id") % 10 + 1).cast("int")
        ),
    }
    out = spark.range(offset, offset + n)
    for i, (name, kind) in enumerate(fixed.FEATURE_TYPES.items()):
        values.setdefault(name, (F.col("id") * (i + 3) % (5 + i)).cast("double" if kind == "double" else "long"))
    ordered = ["id", *fixed.FEATURES, "attack_cat"]
    return out.select(*[values[c].alias(c) for c in ordered]).withColumn(
        "label", (F.col("attack_cat") != "Normal").cast("int")
    )


def test_whole_flow_table_through_every_loader(spark):
    train, test = make_flows(spark, 2000), make_flows(spark, 500, 10_000)
    a, b = [materialise(t) for t in prep.prepare_offline(train, test, cap=120)]
    assert set(a.columns) == {"id", *fixed.FEATURES, "new_label"}
    assert max(r["count"] for r in a.groupBy("new_label").count().collect()) <= 120
    assert b.join(a, fixed.FEATURES + ["new_label"]).count() == 0
    static = 30
    for pair in (prep.load_grouped(a, a, "multi"), prep.load_without_rare(a, a)):
        row = pair[0].first()
        assert len(row["x_static"]) == static and len(row["x_dynamic"]) == 10
    wide = prep.load_baseline(a, a, "binary")[0]
    assert sorted({r[0] for r in wide.select("new_label").distinct().collect()}) == [0, 1]
    ordered = prep.load_reordered(a, a, "multi")[0]
    assert ordered.columns[1:6] == ["spkts", "dpkts", "sbytes", "dbytes", "rate"]
    two = prep.load_two_class(a, a, cap=50)[0]
    assert [r[1] for r in sorted(two.groupBy("new_label").count().collect())] == [50, 50]


def test_capped_sizes_of_offline_preparation(spark):
    train, test = make_flows(spark, 2000), make_flows(spark, 500, 10_000)
    a, _ = prep.prepare_offline_binary(train, test)
    assert a.count() > 0
    for mode in fixed.MODES:
        x, y = prep.prepare_online(train, test, mode)
        assert "proto_tcp" in x.columns and "is_sm_ips_ports" not in x.columns
        assert x.columns == y.columns
        assert x.agg(F.max("dur")).first()[0] <= 1.0


@pytest.mark.parametrize(("left", "right"), [("int", "long"), ("int", "double"), ("long", "int"), ("double", "int"), ("float", "double")])
def test_leaks_are_found_by_value(spark, left, right):
    victim = spark.createDataFrame([(1,), (2,), (None,)], "v int").withColumn("v", F.col("v").cast(left))
    guard = spark.createDataFrame([(1,), (None,), (7,)], "v int").withColumn("v", F.col("v").cast(right))
    assert [r.v for r in dedup.remove_leaks(victim, guard).collect()] == [2]


def test_csv_refuses_lines_of_another_width(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("t", T.StringType())])
    for bad in ("1,a,b", "1"):
        (tmp_path / "bad.csv").write_text(f"id,t\n2,x\n{bad}\n")
        with pytest.raises(Exception, match="MALFORMED|malformed"):
            flow_files.read_csv(spark, str(tmp_path / "bad.csv"), schema).collect()


def test_csv_keeps_line_breaks_and_backslashes(spark, tmp_path):
    texts = ["a\nb", "\\", "\\n", "\\\\n\n", "x\r\ny\\", "\\r\\\\\r"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    flow_files.write_csv(df, str(tmp_path / "t"))
    assert {r.id: r.t for r in flow_files.read_csv(spark, str(tmp_path / "t"), df.schema).collect()} == dict(enumerate(texts))


def test_working_tables_are_dropped(spark):
    with session.working_tables(spark):
        kept = session.materialise(spark.range(5), "t")
        assert kept.count() == 5
        path = kept.inputFiles()[0].removeprefix("file://")
    import os

    assert not os.path.exists(path)
    assert session.settle(spark.range(5)).count() == 5


def test_small_tables_are_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(session, "SMALL_BYTES", 1000)
    wide = spark.range(10).select(F.repeat(F.lit("x"), 500).alias("t"))
    assert session.small_or_none(wide) is None and session.settle(wide).count() == 10
    assert len(session.small_or_none(spark.range(3))) == 3


def test_ordinal_codes_of_nan_are_the_same_on_every_path(spark, monkeypatch):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (0.5,), (None,)], "v double")
    for literal, small in ((200, 100_000), (0, 100_000), (0, 0)):
        monkeypatch.setattr(encode, "LITERAL_CATEGORIES", literal)
        monkeypatch.setattr(encode, "SMALL_ROWS", small)
        coded = encode.OrdinalEncoder.fit("v", df).apply(df, "code").collect()
        assert {repr(r.v): r.code for r in coded} == {"0.5": 0, "1.0": 1, "nan": 2, "None": None}


def test_one_hot_layouts(spark, monkeypatch):
    """The caller's layout stays at any number of values; columns beyond the limit are an error that names the way out."""
    train = spark.createDataFrame([(1, "a", "x"), (2, "b", None), (3, None, "y")], "id int, p string, s string")
    test = spark.createDataFrame([(4, "c", "x")], "id int, p string, s string")
    pair = encode.one_hot_pair(train, test, ["p", "s"], layout="sparse")
    got = {r.id: (r.onehot["size"], r.onehot["indices"]) for df in pair for r in df.collect()}
    assert got == {1: (5, [0, 3]), 2: (5, [1]), 3: (5, [4]), 4: (5, [2, 3])}
    one = encode.one_hot_pair(train, test, ["p", "s"], "train", layout="sparse")[1].first().onehot
    assert (one["size"], one["indices"]) == (4, [2])
    wide = encode.one_hot_pair(train, test, ["p", "s"])[1]
    assert wide.columns == ["id", "p_a", "p_b", "p_c", "s_x", "s_y"] and tuple(wide.first()) == (4, 0, 0, 1, 1, 0)
    monkeypatch.setattr(encode, "ONE_HOT_CATEGORIES", 3)
    assert encode.one_hot_pair(train, test, ["p", "s"], layout="sparse")[1].columns == ["id", "onehot"]
    with pytest.raises(ValueError, match='layout="sparse"'):
        encode.one_hot_pair(train, test, ["p", "s"])


def test_counters_are_those_of_a_separate_report(spark):
    train, test = make_flows(spark, 900), make_flows(spark, 300, 10_000)
    gaps = [t.withColumn("state", F.when(F.col("id") % 7 != 0, F.col("state"))) for t in (train, test)]
    (a, b), counts = prep.prepare_offline_counted(gaps[0].union(gaps[0]), gaps[1], cap=20)
    found = {c["split"]: c for c in counts}
    for side, df, out in (("train", gaps[0].union(gaps[0]), a), ("test", gaps[1], b)):
        got, whole = found[side], clean.drop_incomplete(clean.blanks_to_null(df))
        assert got["rows_in"] == df.count() and got["gaps"] == df.count() - whole.count() > 0
        assert got["rows_out"] == out.count()
        assert got["rows_in"] - got["rows_out"] == sum(got[c] for c in ("gaps", "copies", "unlabelled", "leaks", "capped"))
    assert found["train"]["copies"] >= 900 - found["train"]["gaps"] // 2 and found["train"]["leaks"] == 0
    # The same rows as cleaning each set and taking the leaks out by a join.
    kept = prep.clean_flows(gaps[0].union(gaps[0]))
    features = [c for c in kept.columns if c != "id"]
    left = dedup.remove_leaks(prep.clean_flows(gaps[1]), kept, on=features)
    (x, y), _ = prep.prepare_offline_counted(gaps[0].union(gaps[0]), gaps[1], cap=10_000)
    for one, other in ((x, kept), (y, left)):
        assert one.select(*other.columns).exceptAll(other).count() == other.exceptAll(one.select(*other.columns)).count() == 0


def test_online_counters_equal_the_pair_report(spark):
    train, test = make_flows(spark, 900), make_flows(spark, 300, 10_000)
    counts = {c["split"]: c for c in prep.prepare_online_counted(train.union(train), test, "binary")[1]}
    for side in counts.values():
        assert side["rows_in"] == side["gaps"] + side["copies"] + side["leaks"] + side["rows_out"]
    assert counts["test"]["leaks"] == 0 and counts["train"]["copies"] >= 900 - counts["train"]["gaps"] // 2


def test_counters_of_a_pair_need_no_scan_of_their_own(spark):
    from pyspark.sql import Observation

    rows = spark.range(500).select("id", (F.col("id") % 50).alias("x"), (F.col("id") % 3 == 0).alias("is_test"))
    seen = Observation()
    pair = dedup.dedup_pair(rows, "id", "is_test", observation=seen)
    plan = pair._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Range (") == 1 and plan.count("CollectMetrics") == 1
    assert sorted(map(tuple, pair.collect())) == sorted(map(tuple, dedup.dedup_pair(rows, "id", "is_test").collect()))
    report = {r.split: r.asDict() for r in dedup.pair_report(rows, "id", "is_test").collect()}
    assert all({k: c[k] for k in report[c["split"]]} == report[c["split"]] for c in dedup.observed_counts(seen))


def test_counters_of_empty_sets(spark):
    train, test = make_flows(spark, 0), make_flows(spark, 0, 10_000)
    _, counts = prep.prepare_offline_counted(train, test)
    assert all(v == 0 for c in counts for k, v in c.items() if k != "split")


def test_leak_filter_passes_every_leak_and_few_others(spark):
    guard = spark.range(2000).select((F.col("id") * 3).alias("x"), F.when(F.col("id") % 5 != 0, "a").alias("s"))
    victim = spark.range(30_000).select("id", F.col("id").cast("int").alias("x"), F.when(F.col("id") % 15 != 0, "a").alias("s"))
    exact = dedup.remove_leaks(victim, guard, ["x", "s"])
    leaks = victim.count() - exact.count()
    assert leaks == 2000
    for bits, most in ((1 << 15, 0.03), (1 << 22, 0.0005)):
        passed = dedup.may_leak(victim, guard, ["x", "s"], bits).filter("may_leak").count()
        assert leaks <= passed <= leaks + most * 28_000
        assert rows(dedup.remove_leaks_filtered(victim, guard, ["x", "s"], bits)) == rows(exact)
    assert rows(dedup.remove_leaks_filtered(victim, guard.limit(0), ["x", "s"])) == rows(victim)
    assert dedup.remove_leaks_filtered(victim.limit(0), guard, ["x", "s"]).count() == 0
