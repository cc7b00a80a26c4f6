"""Batches of a request stream: post-processing per batch, failed batches, replays."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from clickforge.operators import requests as RQ
from clickforge.sources import views as V
from clickforge.streaming import serving as ST


def test_post_processing_is_per_batch(spark):
    late, score = ST.ad_prior_scorer(spark, SF_SMALL)
    scored = score(V.requests(spark, SF_SMALL).where(late))
    rows = sorted((r["event_id"], r["success"], r["raw_prediction"]) for r in scored.collect())
    got = {r["event_id"]: r for r in RQ.process_batches(scored, 90).collect()}
    assert set(got) == {i for i, _, _ in rows} and len(got) == len(rows)
    for k in range(0, len(rows), 90):
        part = rows[k:k + 90]
        raw = np.array([p for _, ok, p in part if ok])
        p1 = np.clip(raw, max(np.quantile(raw, 0.01) * 0.1, 1e-4), min(np.quantile(raw, 0.99) * 1.1, 0.9999))
        factor = 0.0201 / p1.mean() if abs(p1.mean() - 0.0201) > 0.001 else 1.0
        want = iter(np.clip(p1 * factor, 1e-4, 0.9999))
        for i, ok, _ in part:
            assert got[i]["batch_no"] == k // 90
            assert got[i]["ctr_prediction"] == pytest.approx(next(want) if ok else 0.0201, rel=1e-12)


def test_failed_batch_is_answered_and_the_stream_goes_on(spark, tmp_path):
    """Three files, three micro-batches; the scorer breaks on the one that holds event 7."""
    events = V.read_table(spark, SF_SMALL, "events").where("event_id < 30").coalesce(1)
    for k in range(3):
        events.where(F.col("event_id") % 3 == k).write.mode("append").parquet(str(tmp_path / "in"))
    late, score = ST.ad_prior_scorer(spark, SF_SMALL)
    calls = []

    def fragile(batch):
        calls.append(batch.count())
        if batch.where("event_id = 7").count():
            raise ValueError("no model")
        return score(batch)

    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rows = ST.processed_stream(V.requests_from_events(stream), fragile, 5).collect()
    assert calls == [10, 10, 10] and sorted(r["event_id"] for r in rows) == sorted(r["event_id"] for r in events.collect())
    assert {r["batch_id"] for r in rows} == {0, 1, 2}
    broken = [r for r in rows if r["error"]]
    assert {r["event_id"] % 3 for r in broken} == {1} and len(broken) == 10
    assert all(r["error"] == "ValueError: no model" and r["ctr_prediction"] == 0.0201 and not r["success"] and r["recommendation"] == "skip"
               and r["confidence"] == 0 and r["model_used"] == "error" for r in broken)
    assert all(r["model_used"] == "ad_prior" for r in rows if not r["error"])
