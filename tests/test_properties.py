"""Property tests: folds, weights, CTR correction, quantiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickforge.operators import calibrate as CAL
from clickforge.operators import ensemble as ENS
from clickforge.operators import split as SPL
from clickforge.sources import views as V
from conftest import SF_SMALL


def test_fold_sizes_per_class_differ_by_at_most_one(spark):
    imp = V.impressions(spark, SF_SMALL).select("row_key", "clicked")
    f = SPL.stratified_folds(imp, "clicked", 5, 42)
    sizes = f.groupBy("clicked", "fold").count().collect()
    for c in (0, 1):
        s = [r["count"] for r in sizes if r["clicked"] == c]
        assert len(s) == 5 and max(s) - min(s) <= 1


def test_folds_independent_of_shuffle_partitions(spark):
    imp = V.impressions(spark, SF_SMALL).select("row_key", "clicked")
    seen = []
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 8, 200):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            seen.append(sorted(tuple(r) for r in SPL.stratified_folds(imp, "clicked", 5, 42)
                               .select("row_key", "fold").collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert seen[0] == seen[1] == seen[2]


def test_weights_sum_to_one(spark):
    long = V.long_predictions(spark, SF_SMALL)
    w = ENS.weight_table(ENS.model_scores(long)).agg(
        *[F.sum(c).alias(c) for c in ("perf_weight", "stack_weight", "corr_weight")]).first()
    for v in w:
        assert v == pytest.approx(1.0)


def test_ctr_correction_hits_target(spark):
    pr = V.predictions(spark, SF_SMALL).select("row_key", F.col("p_m1").alias("p"))
    out = CAL.ctr_correction(pr, "p")
    r = out.agg(F.avg("p_corrected").alias("m"), F.min(F.col("ctr_ok").cast("int")).alias("ok")).first()
    assert r["m"] == pytest.approx(0.0191, abs=1e-9)
    assert r["ok"] == 1


def test_exact_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(3)
    v = np.round(rng.random(1000), 3)
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    qs = [0.0, 0.01, 0.37, 0.5, 0.99, 1.0]
    r = CAL.exact_quantiles(df, "v", qs, buckets=16).first()
    for i, q in enumerate(qs):
        assert r[f"q{i}"] == pytest.approx(float(np.percentile(v, q * 100)), abs=1e-12)


@pytest.mark.parametrize("bracket", [0.005, 1e-9])
def test_quantiles_of_groups_and_brackets_that_miss(spark, bracket):
    """Hot values, small groups, NULL and NaN; brackets too narrow to hold a position are widened."""
    rng = np.random.default_rng(5)
    groups = {"hot": np.append(np.full(1500, 0.25), rng.random(3000)), "one": np.array([0.5]), "two": np.array([1.0, -2.0]), None: rng.normal(size=900)}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("one", None), ("two", float("nan")), ("empty", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    qs = [0.0, 0.01, 0.3, 0.5, 0.99, 1.0]
    got = {r["k"]: r for r in CAL.exact_quantiles(df, "v", qs, ["k"], bracket=bracket).collect()}
    assert set(got) == set(groups)
    for k, v in groups.items():
        assert [got[k][f"q{i}"] for i in range(len(qs))] == pytest.approx([float(np.percentile(v, q * 100)) for q in qs], abs=1e-12)


def test_few_distinct_scores_are_counted_exactly(spark):
    df = spark.createDataFrame([(g, float(i % n)) for g, n in (("few", 999), ("just", 1000), ("many", 4000)) for i in range(4000)], "g string, p double")
    got = {r["g"]: r for r in CAL._spread(df, F.col("p"), ["g"]).collect()}
    assert got["few"]["__nd"] == 999 and got["just"]["__nd"] == 1000 and got["many"]["__nd"] >= 2000
    assert got["few"]["__sd"] == pytest.approx(float(np.std([i % 999 for i in range(4000)])), rel=1e-12)
    assert CAL._spread(df.where("g = 'few'"), F.col("p"), []).first()["__nd"] == 999


def test_generated_ids_are_dense(spark):
    _, te = V.split_train_test(V.impressions(spark, SF_SMALL).select("row_key"))
    ids = SPL.generated_ids(te).select("ID").collect()
    got = sorted(r[0] for r in ids)
    assert got == [f"TEST_{i:07d}" for i in range(len(got))]


def test_dataset_check_counts_rows_and_bytes(spark):
    import os
    from clickforge.sources import tables as TB
    t = {"lineitem": TB.read_table(spark, SF_SMALL, "lineitem")}
    r = TB.dataset_check(t, {"lineitem": 6000}, {"lineitem": 10}).first()
    assert r["row_count"] == t["lineitem"].count()
    assert r["bytes"] == os.path.getsize(f"{SF_SMALL}/lineitem.parquet")
    assert r["size_ok"] is True
