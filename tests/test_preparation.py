"""Types found from cells, and saved preparations."""

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlab.operators import preparation as p
from flowlab.sources import flows as flow_files
from flowlab.sources import infer

ROOT = Path(__file__).resolve().parents[1]

CELLS = {
    "bigint": ["1", "-20", "+3", " 4 ", "0007", "9223372036854775807", "NA", None],
    "double": ["1", "2.5", ".5", "1e-3", "-7.", "inf", "null", ""],
    "boolean": ["true", "FALSE", "NaN"],
    "timestamp": ["2024-02-29", "2024-01-01 10:20", "2024-01-01T10:20:30.5"],
    "string": [
        ["1", "x"], ["true", "1"], ["2024-01-01", "5"], ["9223372036854775808"], ["1234567890123456", "0.5"],
        ["2023-02-29"], ["NA", "", None, "  "], ["1d"], ["0x10"], ["1,5"], ["--1"], ["e5"], ["."],
    ],
}


def types(spark, cells):
    df = spark.createDataFrame([(c,) for c in cells], "`a column` string")
    return infer.infer_types(df)[0]


@pytest.mark.parametrize("name", ["bigint", "double", "boolean", "timestamp"])
def test_kinds_of_cells(spark, name):
    assert types(spark, CELLS[name])[1].simpleString() == name


def test_cells_that_make_text(spark):
    assert [types(spark, c)[1].simpleString() for c in CELLS["string"]] == ["string"] * len(CELLS["string"])


def test_width_and_missing_cells(spark):
    assert types(spark, CELLS["bigint"])[2:] == (19, 2)
    assert types(spark, [])[1:] == (T.StringType(), 0, 0)


def test_one_bad_cell_in_the_last_file(spark, tmp_path):
    folder = tmp_path / "t"
    folder.mkdir()
    for i in range(5):
        (folder / f"part-{i}.csv").write_text("id,n\n" + "".join(f"{i * 100 + k},{k}\n" for k in range(50)))
    assert dict(flow_files.read_csv(spark, str(folder)).dtypes) == {"id": "bigint", "n": "bigint"}
    (folder / "part-9.csv").write_text("id,n\n900,1\n901,?\n")
    read = flow_files.read_csv(spark, str(folder))
    assert dict(read.dtypes) == {"id": "bigint", "n": "string"}
    assert {r["n"] for r in read.where("id >= 900").collect()} == {"1", "?"}
    # The order of files and their number do not matter.
    spread = read.select(F.col("id").cast("string"), "n").repartition(7)
    assert [t[1].simpleString() for t in infer.infer_types(spread)] == ["bigint", "string"]


def test_inference_is_one_pass_without_a_shuffle_of_rows(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("a"), F.lit("x").alias("b"))
    kinds = infer.kind(F.col("a"))
    plan = df.agg(F.bit_or(kinds))._jdf.queryExecution().toString()
    assert "partial_bit_or" in plan


def test_headers_that_disagree(spark, tmp_path):
    folder = tmp_path / "t"
    folder.mkdir()
    (folder / "a.csv").write_text("id,n\n1,2\n")
    (folder / "b.csv").write_text("id,other\n1,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        flow_files.read_csv(spark, str(folder)).collect()


TRAIN = [("tcp", "http", "a", 1.0, 5.0), ("udp", "-", "b", 2.0, 5.0), ("tcp", "dns", " ", 9.0, 5.0), ("icmp", "dns", "b", 6.0, 5.0), ("udp", "http", "a", 3.0, 5.0)]
SCHEMA = "proto string, service string, state string, x double, y double"


def stages(layout="ordinal", unseen="null"):
    return [
        p.Cleaning(dropCols=["id"]),
        p.Codes(inputCols=["proto", "service"], layout=layout, unseen=unseen),
        p.Scaling(inputCols=["x", "y"], kind="minmax"),
    ]


def test_fitted_stages_equal_the_plain_functions(spark):
    train = spark.createDataFrame(TRAIN, SCHEMA)
    rows = Pipeline(stages=stages()).fit(train).transform(train).orderBy("x").collect()
    # Sorted values: icmp, tcp, udp and dns, http, unknown. The row with a blank state is gone.
    assert [(r["proto"], r["service"], r["x"], r["y"]) for r in rows] == [(1, 1, 0.0, 0.0), (2, 2, 0.2, 0.0), (2, 1, 0.4, 0.0), (0, 0, 1.0, 0.0)]


@pytest.mark.parametrize(("layout", "unseen"), [("ordinal", "other"), ("onehot", "other"), ("onehot", "null")])
def test_saved_pipeline_in_a_new_session(spark, tmp_path, layout, unseen):
    """Another process loads what was saved and gives unseen rows the same codes."""
    model = Pipeline(stages=stages(layout, unseen)).fit(spark.createDataFrame(TRAIN, SCHEMA))
    model.write().save(str(tmp_path / "m"))
    new = [("gre", "http", "c", 11.0, 7.0), ("tcp", "-", "a", 6.0, 5.0)]
    here = sorted(map(str, PipelineModel.load(str(tmp_path / "m")).transform(spark.createDataFrame(new, SCHEMA)).collect()))
    assert here == sorted(map(str, model.transform(spark.createDataFrame(new, SCHEMA)).collect()))
    code = (
        "from pyspark.ml import PipelineModel\nfrom flowlab.session import build_session\n"
        "spark = build_session('local[2]', **{'spark.ui.enabled': 'false', 'spark.sql.shuffle.partitions': '2'})\n"
        f"df = spark.createDataFrame({new!r}, {SCHEMA!r})\n"
        f"print('ROWS', sorted(map(str, PipelineModel.load({str(tmp_path / 'm')!r}).transform(df).collect())))"
    )
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=180, cwd=ROOT, env={**__import__("os").environ, "PYTHONPATH": str(ROOT)})
    assert f"ROWS {here}" in out.stdout, out.stderr[-2000:]


def test_unseen_values(spark):
    train, new = spark.createDataFrame(TRAIN, SCHEMA), spark.createDataFrame([("gre", "http", "a", 1.0, 1.0)], SCHEMA)
    assert p.Codes(inputCols=["proto"]).fit(train).transform(new).first()["proto"] is None
    assert p.Codes(inputCols=["proto"], unseen="other").fit(train).transform(new).first()["proto"] == 3
    with pytest.raises(Exception, match="unseen value in proto: gre"):
        p.Codes(inputCols=["proto"], unseen="error").fit(train).transform(new).collect()
    with pytest.raises(ValueError, match="layout"):
        p.Codes(inputCols=["proto"], layout="wide")


def test_selection(spark):
    df = spark.createDataFrame([(float(i), float(i % 2), 1.0, 2.0 * i) for i in range(20)], "a double, b double, c double, label double")
    model = p.Selection(inputCols=["a", "b", "c"], labelCol="label", threshold=0.5).fit(df)
    assert model.transform(df).columns == ["a", "label"]


def test_many_values_stay_a_table(spark):
    """Codes of many values are numbered by a sort and joined; equal to their ranks."""
    df = spark.range(3000).select(F.format_string("v%05d", F.col("id") * 7 % 3000).alias("v"))
    out = p.Codes(inputCols=["v"]).fit(df).transform(df.withColumn("k", F.substring("v", 2, 5).cast("int"))).where("v <> k or v is null")
    assert out.count() == 0
