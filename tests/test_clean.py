"""Cleaning expressions on the hand-made edge tables of FIXTURES §4."""

import pytest
from pyspark.sql import functions as F

from clickforge.functions import exprs as X
from clickforge.operators import detect as D


def test_category_int_edges(spark):
    vals = ["M", "1.05", "10.0", "7", None, "None", "1d", "0x10", " 3 ", "1e3"]
    want = [-1, 15, 10, 7, -1, -1, -1, -1, 3, 1000]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r[0] for r in df.select(X.category_int(F.col("v"))).collect()]
    assert got == want


def test_inf_marks_text_column(spark):
    df = spark.createDataFrame([("1",), ("inf",), ("-Infinity",), ("2.0",)], "v string")
    got = [r[0] for r in df.select(X.category_has_inf(F.col("v"))).collect()]
    assert got == [False, True, True, False]


def test_time_period_edges(spark):
    hours = [-1.0, 0.0, 6.0, 6.5, 12.0, 18.0, 24.0, 25.0]
    want = [None, 0.0, 0.0, 1.0, 1.0, 2.0, 3.0, None]
    df = spark.createDataFrame([(h,) for h in hours], "h double")
    assert [r[0] for r in df.select(X.time_period(F.col("h"))).collect()] == want


def test_row_stats(spark):
    df = spark.createDataFrame([(None, None, None), (1.0, None, None), (2.0, 2.0, 2.0), (1.0, None, 3.0)],
                               "a double, b double, c double")
    s = X.row_stats(["a", "b", "c"])
    rows = df.select(*[s[k].alias(k) for k in ("mean", "std", "max", "min")]).collect()
    assert rows[0]["mean"] is None and rows[0]["max"] is None
    assert rows[1]["mean"] == 1.0 and rows[1]["std"] is None
    assert rows[2]["std"] == 0.0
    assert rows[3]["mean"] == 2.0 and rows[3]["std"] == pytest.approx(2 ** 0.5)


def test_md5_mod_matches_python(spark):
    import hashlib
    words = ["user_42", "ad_7", "x", ""]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r[0] for r in df.select(X.md5_mod(F.col("w"), 1_000_000)).collect()]
    assert got == [int(hashlib.md5(w.encode()).hexdigest(), 16) % 1_000_000 for w in words]
    assert got[0] == 817712


def test_label_candidates_edges(spark):
    df = spark.createDataFrame(
        [(1, 0, None, 0, 1, "a") if i < 5 else (0, 0, None, 1, 0, "b") for i in range(100)],
        "target int, click_flag int, empty int, my_y int, other int, txt string")
    t = {r["column_name"]: r for r in D.label_candidates(df).collect()}
    # target: rate 0.05 passes stage 1
    assert t["target"]["stage"] == 1 and t["target"]["selected"]
    assert t["empty"]["is_binary"] is True
    assert t["txt"]["is_binary"] is False
    assert sum(r["selected"] for r in t.values()) == 1


def test_label_stage3_picks_best_score(spark):
    df = spark.createDataFrame([(1 if i < 30 else 0, 1 if i < 3 else 0) for i in range(100)], "a int, b int")
    t = {r["column_name"]: r for r in D.label_candidates(df).collect()}
    assert t["b"]["selected"] and t["b"]["score"] == 100.0
    assert t["a"]["score"] == 0.0
