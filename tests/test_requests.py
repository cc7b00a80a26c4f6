"""Open request contexts, observed counters, serving state, text order, manifests and claims."""

from __future__ import annotations

import random

import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from clickforge.operators import encode as E
from clickforge.operators import ranking as R
from clickforge.operators import requests as RQ
from clickforge.sources import experiments as EXP
from clickforge.sources import tables as TB
from clickforge.sources import views as V
from clickforge.streaming import serving as ST


def test_values_with_one_prefix_fill_the_ranges_evenly(spark):
    n = 100_000
    d = spark.range(n).select(F.format_string("user_%06d", (F.col("id") * 7919) % n).alias("value"), F.lit("c").alias("column_name"))
    rows, _ = R.laid_out(d, ["column_name"], [F.col("value").asc()], parts=16, keep=["value"])
    sizes = [r["count"] for r in rows.groupBy("__part").count().collect()]
    assert len(sizes) >= 14 and max(sizes) < 3 * n / 16
    placed = R.positions(d, ["column_name"], [F.col("value").asc()])
    assert placed.where(F.col("row_idx") != F.substring("value", 6, 6).cast("long")).count() == 0 and placed.count() == n


def test_codes_of_test_only_values_follow_the_text(spark):
    names = [f"user_{i}" for i in range(300)]
    random.Random(1).shuffle(names)
    train = spark.createDataFrame([("a",), ("a",), ("b",)], "c string")
    test = spark.createDataFrame([(x,) for x in [*names, "b", None]], "c string")
    got = {r["value"]: r["code"] for r in E.fit_frequency_codes(train, test, ["c"]).collect()}
    assert got == {"a": 0, "b": 1, **{v: i + 2 for i, v in enumerate(sorted([*names, "missing"]))}}


CONTEXTS = {
    1: '{"k": 3, "t": " 2.5 ", "yes": true, "no": false, "word": "x", "nil": null, "deep": {"a": [1]}, "hour": 4, "feat_e_1": 9, "feat_e_3": "w"}',
    2: "[1, 2]", 3: "not json", 4: None, 5: "{}", 6: "",
}


def bucket(text):
    import hashlib
    return float(int(hashlib.md5(text.encode()).hexdigest(), 16) % 1000)


def test_open_context(spark):
    d = spark.createDataFrame(list(CONTEXTS.items()), "event_id long, context string")
    got = {r["event_id"]: r["features"] for r in RQ.open_features(d).collect()}
    defaults = {k: pytest.approx(v, rel=1e-6) for k, v in RQ.DEFAULT_FEATURES.items()}
    assert got[1] == {**defaults, "feat_e_1": 9.0, "feat_e_3": bucket("w"), "context_k": 3.0, "context_t": 2.5, "context_yes": 1.0,
                      "context_no": 0.0, "context_word": bucket("x"), "context_nil": bucket("None"), "context_deep": bucket('{"a":[1]}')}
    assert all(got[i] == defaults for i in range(2, 7))
    wide = RQ.known_features(RQ.open_features(d), ["context_k", "feat_e_1", "never"]).orderBy("event_id").first()
    assert (wide["context_k"], wide["feat_e_1"], wide["never"]) == (3.0, 9.0, 0.0)
    keys = {r["key"]: (r["requests"], r["numeric"]) for r in RQ.context_keys(d).collect()}
    assert keys["k"] == (1, 1) and keys["word"] == (1, 0) and keys["hour"] == (1, 1) and len(keys) == 10
    assert RQ.open_features(d.limit(0)).count() == 0


def test_a_present_default_overrides(spark):
    req = V.requests(spark, SF_SMALL).limit(3).withColumn("feat_e_1", F.when(F.col("event_id") == 0, "12.5").when(F.col("event_id") == 1, "w"))
    got = {r["event_id"]: r["feat_e_1"] for r in RQ.request_features(req).collect()}
    assert got[0] == 12.5 and all(v == 65.0 for i, v in got.items() if i)


def test_observed_usage_equals_a_scan(spark, tmp_path):
    late, score = ST.ad_prior_scorer(spark, SF_SMALL)
    calls = RQ.pipeline_flags(score(V.requests(spark, SF_SMALL).where(late)).withColumn("use_ensemble", F.col("event_id") % 2 == 0))
    out, seen = RQ.observed_usage(calls, RQ.PIPELINE_FLAGS)
    out.write.parquet(str(tmp_path / "out"))
    (want,) = RQ.api_usage(calls, RQ.PIPELINE_FLAGS).collect()
    (got,) = RQ.usage_report(out, seen, RQ.PIPELINE_FLAGS).collect()
    assert got == want and got["full_pipeline_count"] + got["calibration_count"] == got["total_api_calls"] and got["ensemble_count"] == 0


def test_serving_state_over_several_batches(spark, tmp_path):
    events = V.read_table(spark, SF_SMALL, "events").coalesce(1)
    for k in range(3):
        events.where(F.col("event_id") % 3 == k).write.mode("append").parquet(str(tmp_path / "in"))
    late, score = ST.ad_prior_scorer(spark, SF_SMALL)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    states = ST.serving_state(score(V.requests_from_events(stream).where(late)), recent=50)
    assert all(len(r["ids"]) <= 50 for r in states.collect())
    (got,) = ST.merged_stats(states, 50).collect()
    (want,) = RQ.serving_stats(score(V.requests(spark, SF_SMALL).where(late)), recent=50).collect()
    assert set(got.asDict()) == set(want.asDict())
    for c, v in want.asDict().items():
        assert got[c] == (pytest.approx(v, rel=1e-9, abs=1e-12) if isinstance(v, float) else v), c


def test_manifest_names_the_broken_file(spark, tmp_path):
    d = spark.range(10).select("id", (F.col("id") * 2).alias("x"))
    d.coalesce(1).write.parquet(str(tmp_path / "t"))
    (tmp_path / "t" / "broken.parquet").write_bytes(b"PAR1 this is no table PAR1")
    rows, manifest = TB.read_with_manifest(spark, str(tmp_path / "t"), d.schema)
    assert rows.count() == 10
    got = {r["file"].rsplit("/", 1)[1]: (r["rows"], r["skipped"]) for r in manifest.collect()}
    assert len(got) == 2 and got.pop("broken.parquet") == (0, True) and list(got.values()) == [(10, False)]


def test_two_writers_get_two_numbers(spark, tmp_path):
    path = str(tmp_path / "experiments")
    assert [EXP.claim_experiment_num(spark, path) for _ in range(3)] == [1, 2, 3]
    spark.createDataFrame([(7,)], "experiment_num int").write.parquet(path)
    assert [EXP.claim_experiment_num(spark, path) for _ in range(2)] == [8, 9]
