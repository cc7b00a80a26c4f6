"""Cases that the fixture tables do not reach."""

import pytest
from conftest import SF_SMALL
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import functions as F

from clickforge.operators import detect as D
from clickforge.operators import encode as E
from clickforge.operators import ensemble as ENS
from clickforge.operators import split as SPL
from clickforge.operators.ranking import row_index, value_prefix_sums
from clickforge.plans import features as FE
from clickforge.sources import experiments as EXP
from clickforge.sources import tables as TB
from clickforge.sources import views as V


def test_head_rows_are_the_first_rows_of_the_file(spark):
    import pyarrow.parquet as pq
    t = TB.read_table(spark, SF_SMALL, "lineitem")
    want = pq.read_table(f"{SF_SMALL}/lineitem.parquet").slice(0, 50)
    assert [r[0] for r in t.select("l_orderkey").limit(50).collect()] == want.column("l_orderkey").to_pylist()


def test_raw_hour_and_stored_model(spark, tmp_path):
    tr, te = V.split_train_test(V.impressions(spark, SF_SMALL))
    fm, _, fitted = FE.build_features(tr, te, cross_fit="shared", time_period_on="raw_hour")
    want = {r["row_key"]: r for r in fitted.collect()}
    fm.save(str(tmp_path / "model"))
    back = FE.FeatureModel.load(spark, str(tmp_path / "model"))
    for model in (fm, back):
        out = model.transform(te.withColumn("another_id", F.lit(1)))
        assert {r["row_key"]: r for r in out.collect()} == want
    hours = {r["row_key"]: r["hour"] for r in te.collect()}
    bins = {k: 0 if h <= 6 else 1 if h <= 12 else 2 if h <= 18 else 3 for k, h in hours.items()}
    assert {k: r["time_period"] for k, r in want.items()} == bins


def test_model_without_finite_scores_keeps_the_floor(spark):
    rows = [(i, i % 2, 0.1 + 0.5 * (i % 2), float("nan")) for i in range(20)]
    wide = spark.createDataFrame(rows, "row_key int, clicked int, m1 double, m2 double")
    w = {r["model"]: r for r in ENS.weight_table(ENS.model_scores(ENS.to_long(wide, ["m1", "m2"], ["row_key", "clicked"]))).collect()}
    assert set(w) == {"m1", "m2"} and w["m2"]["perf_weight"] == pytest.approx(0.1 / 1.1)


def test_log_entry_without_auc(spark, tmp_path):
    m = spark.createDataFrame([("m1", None, 0.1, 0.02, 0.02, 0.0), ("m2", 0.7, 0.2, 0.02, 0.03, 0.01)],
                              "model string, auc double, ap double, actual_ctr double, predicted_ctr double, ctr_bias double")
    out = {r["model"]: r for r in EXP.log_and_parse([("run", {"a": "1"}, m, None)], str(tmp_path), spark).collect()}
    assert set(out) == {"m1", "m2"} and out["m1"]["auc"] is None and out["m1"]["first_auc"] is None
    assert out["m2"]["auc"] == 0.7 and out["m1"]["ap"] == 0.1


def test_experiment_numbers_only_restart_without_a_table(spark, tmp_path):
    assert EXP.next_experiment_num(spark, str(tmp_path / "none")) == 1
    spark.range(3).write.parquet(str(tmp_path / "other"))
    with pytest.raises((AnalysisException, PySparkException)):
        EXP.next_experiment_num(spark, str(tmp_path / "other"))


def test_two_rows_of_statistics_are_an_error(spark):
    m = spark.createDataFrame([("m1", 0.5, 0.1, 0.02, 0.02, 0.0)],
                              "model string, auc double, ap double, actual_ctr double, predicted_ctr double, ctr_bias double")
    s = spark.createDataFrame([(0.1, 0.1, 0.0, 1.0)] * 2, "mean double, std double, min double, max double")
    with pytest.raises(PySparkException):
        EXP.experiment_rows(m, 1, "run", {"a": "1"}, s).collect()


def test_rates_only_of_binary_columns(spark):
    d = spark.createDataFrame([(1, 0.1, None), (0, 0.2, None), (None, 0.3, None)], "a int, b double, c int")
    st = {r["column_name"]: r for r in D.column_stats(d, distinct_for=["a", "b", "c"]).collect()}
    assert st["a"]["rate"] == 0.5 and st["b"]["rate"] is None and st["c"]["rate"] is None
    assert [st[c]["n_distinct"] for c in "abc"] == [2, 3, 0]
    approx = {r["column_name"]: r["n_distinct"] for r in D.distinct_counts(d, ["a", "b"], approximate=True).collect()}
    assert approx == {"a": 2, "b": 3}


def test_codes_of_values_that_only_the_test_side_has(spark):
    tr = spark.createDataFrame([("b",), ("b",), ("a",)], "v string")
    te = spark.createDataFrame([("z",), ("b",), ("c",), ("aa",)], "v string")
    out = {r["value"]: r["code"] for r in E.fit_frequency_codes(tr, te, ["v"]).collect()}
    assert out == {"b": 0, "a": 1, "aa": 2, "c": 3, "z": 4}


def test_lookups_beyond_the_broadcast_bound(spark, monkeypatch):
    tr = spark.createDataFrame([("b", 1), ("b", 0), ("a", 1)], "v string, y int")
    codes = E.fit_frequency_codes(tr, tr, ["v"])
    want = sorted(E.apply_codes(tr, codes, ["v"]).collect())
    monkeypatch.setattr(E, "LOOKUP_ROWS", 0)
    assert sorted(E.apply_codes(tr, codes, ["v"]).collect()) == want


@pytest.mark.parametrize("buckets", [1, 2, 7, 50])
def test_running_sums_whatever_the_buckets(spark, buckets):
    d = spark.createDataFrame([(g, float(v), 1 + v % 3) for g in range(2) for v in range(60)], "g int, v double, n int")
    out = {(r["g"], r["v"]): r["n_before"] for r in value_prefix_sums(d, ["g"], "v", ["n"], descending=False, buckets=buckets).collect()}
    total = 0
    for v in range(60):
        assert out[0, float(v)] == out[1, float(v)] == total
        total += 1 + v % 3


def test_template_rows_are_spread(spark, tmp_path):
    TB.write_submission(spark.createDataFrame([(f"T{i}", 0.0) for i in range(100)], "ID string, clicked double").coalesce(1), str(tmp_path / "t"))
    pred = spark.createDataFrame([(f"{i:03d}", i / 100) for i in range(100)], "row_key string, p double").repartition(5)
    out = SPL.attach_template_ids(pred, TB.read_id_template(spark, str(tmp_path / "t"))).collect()
    assert {r["row_key"]: r["ID"] for r in out} == {f"{i:03d}": f"T{i}" for i in range(100)}
    short = SPL.attach_template_ids(pred.where("row_key < '010'"), TB.read_id_template(spark, str(tmp_path / "t")))
    assert sorted(r["ID"] for r in short.collect()) == [f"TEST_{i:07d}" for i in range(10)]


def test_template_of_many_files_and_splits(spark, tmp_path, monkeypatch):
    """F8: no task sorts the template, neither to write it nor to place its rows."""
    from clickforge.plans import queries as Q
    path = str(tmp_path / "t")
    ids = [f"T{i:04d}" for i in range(500)]
    TB.write_submission(spark.createDataFrame([(i, 0.0) for i in ids], "ID string, clicked double").repartitionByRange(3, "ID").sortWithinPartitions("ID"), path)
    monkeypatch.setattr(SPL, "materialize_table", lambda d: d.checkpoint(eager=True))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        pred = spark.createDataFrame([(f"{i:03d}", 0.5) for i in range(500)], "row_key string, p double").repartition(5)
        out = SPL.attach_template_ids(pred, TB.read_id_template(spark, path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r["row_key"]: r["ID"] for r in out} == {f"{i:03d}": x for i, x in enumerate(ids)}
    files, own = [], TB.write_submission
    monkeypatch.undo()
    monkeypatch.setattr(TB, "write_submission", lambda d, p: files.append(d.rdd.getNumPartitions()) or own(d, p))
    Q.REGISTRY["submission_template"](spark, "/root/testdata/sf0.001")
    assert files[0] > 1


def test_positions_of_keys_with_one_prefix(spark):
    d = spark.createDataFrame([(f"same-{i:02d}",) for i in range(40)], "k string").repartition(4)
    out = row_index(d, [], F.col("k")).collect()
    assert sorted((r["k"], r["row_idx"]) for r in out) == [(f"same-{i:02d}", i) for i in range(40)]
