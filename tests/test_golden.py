"""Recorded results that the operators must reproduce."""

import pytest
from pyspark.sql import functions as F

from flowlab import fixed
from flowlab.operators import clean, evaluate, profile

# A recorded 10-class confusion matrix and the metrics recorded with it.
MATRIX = [
    [8820, 1, 367, 5114, 1, 191, 487, 0, 19, 0],
    [1, 2742, 403, 197, 19, 28, 4, 3, 21, 0],
    [3, 6, 5774, 800, 31, 653, 165, 40, 118, 0],
    [12, 1, 68, 4293, 13, 195, 150, 39, 39, 0],
    [2, 3, 836, 359, 66, 174, 150, 45, 59, 0],
    [2, 2, 60, 203, 9, 2065, 69, 20, 39, 0],
    [9, 0, 48, 155, 11, 79, 104, 30, 2, 0],
    [0, 0, 25, 131, 9, 62, 85, 21, 12, 0],
    [1, 0, 25, 93, 0, 66, 0, 0, 180, 0],
    [0, 0, 31, 7, 0, 1, 0, 0, 2, 3],
]
METRICS = {
    "accuracy": 0.665358140049208,
    "weighted_precision": 0.7827520803888891,
    "weighted_recall": 0.665358140049208,
    "weighted_f1": 0.677529175238803,
}
REPORT = {
    "0": (1.00, 0.59, 0.74, 15000), "1": (1.00, 0.80, 0.89, 3418), "2": (0.76, 0.76, 0.76, 7590),
    "3": (0.38, 0.89, 0.53, 4810), "4": (0.42, 0.04, 0.07, 1694), "5": (0.59, 0.84, 0.69, 2469),
    "6": (0.09, 0.24, 0.13, 438), "7": (0.11, 0.06, 0.08, 345), "8": (0.37, 0.49, 0.42, 365),
    "9": (1.00, 0.07, 0.13, 44), "macro avg": (0.57, 0.48, 0.44, 36173),
    "weighted avg": (0.78, 0.67, 0.68, 36173),
}

# Recorded class counts of a prepared train set and their percentages.
COUNTS = [15000, 4181, 15000, 15000, 3806, 7522, 1594, 1535, 1091, 127]
PERCENT = [23.13, 6.45, 23.13, 23.13, 5.87, 11.60, 2.46, 2.37, 1.68, 0.20]

# The routing of the prepared columns.
DYNAMIC = [
    "dur", "sttl", "dttl", "sinpkt", "dinpkt", "sjit", "djit", "tcprtt", "ct_state_ttl",
    "ct_flw_http_mthd",
]
REORDERED = [
    "spkts", "dpkts", "sbytes", "dbytes", "rate", "dur", "sinpkt", "dinpkt", "sjit", "djit",
    "stcpb", "dtcpb", "tcprtt", "synack", "ackdat", "ct_srv_src", "ct_state_ttl", "ct_dst_ltm",
    "ct_src_dport_ltm", "ct_dst_sport_ltm", "ct_dst_src_ltm", "ct_flw_http_mthd", "ct_src_ltm",
    "ct_srv_dst", "proto", "service", "state", "sttl", "dttl", "sload", "dload", "sloss",
    "dloss", "swin", "dwin", "smean", "dmean", "trans_depth", "response_body_len",
    "is_sm_ips_ports", "new_label",
]


@pytest.fixture(scope="module")
def cells(spark):
    rows = [(t, p, n) for t, line in enumerate(MATRIX) for p, n in enumerate(line) if n]
    return spark.createDataFrame(rows, "y_true int, y_pred int, n long")


def test_recorded_metrics(cells):
    row = evaluate.average_metrics(cells).first()
    for name, value in METRICS.items():
        assert row[name] == pytest.approx(value, abs=1e-12)
    assert (row["macro_precision"], row["macro_recall"], row["macro_f1"]) == pytest.approx(
        (0.5687, 0.4778, 0.4431), abs=5e-5
    )


def test_recorded_report(cells):
    rows = {r["label"]: r for r in evaluate.class_report(cells).collect()}
    for label, (precision, recall, f1, support) in REPORT.items():
        r = rows[label]
        assert (round(r["precision"], 2), round(r["recall"], 2), round(r["f1"], 2), r["support"]) == (
            precision, recall, f1, support,
        )
    assert round(rows["accuracy"]["f1"], 2) == 0.67


def test_matrix_is_zero_filled(cells):
    full = {(r[0], r[1]): r[2] for r in evaluate.confusion_matrix(cells).collect()}
    assert full == {(t, p): n for t, line in enumerate(MATRIX) for p, n in enumerate(line)}


@pytest.fixture(scope="module")
def recorded_labels(spark):
    pairs = spark.createDataFrame(list(enumerate(COUNTS)), "new_label int, n int")
    return pairs.select("new_label", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))


def test_recorded_percentages(recorded_labels):
    rows = profile.label_distribution(recorded_labels, "new_label", fixed.ATTACK_CODES).collect()
    assert [r["percent"] for r in rows] == PERCENT
    assert [r["n"] for r in rows] == COUNTS
    assert [r["name"] for r in rows] == list(fixed.ATTACK_CODES)


def test_recorded_weights(recorded_labels):
    rows = profile.smoothed_weights(recorded_labels, "new_label").orderBy("new_label").collect()
    expected = [0.6576, 1.2455, 0.6576, 0.6576 / 2, 1.3054, 0.9286, 2.0171, 2.0555, 2.4382, 7.1462]
    assert [r["weight"] for r in rows] == pytest.approx(expected, abs=5e-5)


def test_semantic_groups():
    static, dynamic = clean.semantic_groups(fixed.FEATURES)
    assert dynamic == DYNAMIC
    assert static == [c for c in fixed.FEATURES if c not in DYNAMIC]


def test_listed_groups():
    static, dynamic = clean.listed_groups(fixed.FEATURES)
    assert len(fixed.LISTED_STATIC) == 17 and len(dynamic) == 12
    assert static[:17] == fixed.LISTED_STATIC and len(static) + len(dynamic) == 40


def test_reordering(spark):
    empty = spark.createDataFrame([], ", ".join(f"{c} int" for c in [*fixed.FEATURES, "new_label"]))
    assert clean.reorder_columns(empty).columns == REORDERED
