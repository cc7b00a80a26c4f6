"""Structured Streaming forms of the request scorer.

The reference scores requests one at a time in-process; here the request
table arrives as a stream of files. Scoring is stateless (a stream-static
join with the fitted ad prior plus a precomputed alignment factor), and the
serving statistics are event-time windows with a watermark, emitted in
append mode once a window can no longer change.

Sinks and checkpoints live under ``spark.checkpoint.dir`` (the shared folder
the cluster names), one fresh sub-folder per run.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from clickforge.session import materialize as materialize_table

from clickforge.functions import exprs as X
from clickforge.operators import metrics as M
from clickforge.operators import requests as RQ
from clickforge.session import checkpoint_dir
from clickforge.sources import views as V
from clickforge.sources.tables import read_table


def event_stream(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> DataFrame:
    """``events`` as a file stream (schema taken from the batch table; the
    ``timestamp_ntz`` event time is cast to ``timestamp`` for watermarks)."""
    schema = read_table(spark, sf_dir, "events").schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    ev = r.parquet(sf_dir)
    return ev


def _run_to_table(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a streaming query to completion (``availableNow``) into a parquet
    sink and return the sink as a batch DataFrame."""
    spark = df.sparkSession
    base = f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex[:12]}"
    q = (df.writeStream.format("parquet").option("path", f"{base}/out")
         .option("checkpointLocation", f"{base}/chk").outputMode(mode)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out")


def scored_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stateless scoring of the request stream. The ad prior and the
    alignment factor are fitted on the earlier requests beforehand (a global
    factor, never one derived from the row being scored)."""
    req_static = V.requests(spark, sf_dir)
    late = RQ.time_cut(req_static)
    prior = materialize_table(RQ.fit_ad_prior(req_static.where(~late)))
    factor = materialize_table(RQ.alignment_factor(prior, req_static.where(~late)))
    req = V.requests_from_events(event_stream(spark, sf_dir)).where(late)
    return RQ.score_requests(req, prior, factor)


def stream_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 run to completion: equals the batch ``request_responses``."""
    out = _run_to_table(scored_stream(spark, sf_dir), "scoring")
    return M.round_doubles(out, 9)


def window_stats(scored: DataFrame, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """T2 + T3: per event-time window and model — requests, successes, mean
    prediction, click rate, CTR bias and the G20 alignment score."""
    s = scored.withColumn("event_time", X.ntz_as_utc(F.col("ts"))).withWatermark("event_time", delay)
    a = s.groupBy(F.window("event_time", window).alias("w"), "model_used").agg(
        F.count(F.lit(1)).alias("requests"),
        F.count(F.when(F.col("success"), 1)).alias("successful"),
        F.avg("ctr_prediction").alias("mean_prediction"),
        F.avg(F.col("clicked").cast("double")).alias("click_rate"))
    bias = F.col("mean_prediction") - F.col("click_rate")
    return a.select(X.utc_wall_clock(F.col("w.start")).alias("window_start"),
                    X.utc_wall_clock(F.col("w.end")).alias("window_end"), "model_used",
                    "requests", "successful", "mean_prediction", "click_rate", bias.alias("ctr_bias"),
                    M.ctr_score_expr(F.abs(bias)).alias("ctr_score"))


def stream_window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2/T3 run to completion in append mode: only windows closed by the
    final watermark are emitted."""
    out = _run_to_table(window_stats(scored_stream(spark, sf_dir)), "window_stats")
    return M.round_doubles(out, 9)


def processed_stream(requests: DataFrame, score, size: int = RQ.BATCH_REQUESTS, name: str = "batches") -> DataFrame:
    """P6 on a stream: every micro-batch is scored by ``score`` (a function of the
    batch, in its own session), post-processed per ``size`` requests and written
    to a folder named by its batch id, which a replay after a failure writes
    anew instead of adding to. A batch that can't be scored gives baseline rows
    with the error's text, and the stream goes on. Returns the sink as a table."""
    spark = requests.sparkSession
    base = f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex[:12]}"

    def write(batch: DataFrame, batch_id: int) -> None:
        path = f"{base}/out/batch_id={batch_id}"
        try:
            done = RQ.process_batches(score(batch), size).withColumn("error", F.lit(None).cast("string"))
            done.write.mode("overwrite").parquet(path)
        except Exception as e:  # noqa: BLE001 - P6: the batch is answered with the baseline, the cause is kept in its rows
            RQ.failed_batch(batch, f"{type(e).__name__}: {e}"[:500]).write.mode("overwrite").parquet(path)

    q = (requests.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/chk").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out")


def ad_prior_scorer(spark: SparkSession, sf_dir: str):
    """The later requests' condition, and a scorer of batches by the prior of the earlier ones."""
    req = V.requests(spark, sf_dir)
    late = RQ.time_cut(req)
    prior = materialize_table(RQ.fit_ad_prior(req.where(~late)))
    factor = materialize_table(RQ.alignment_factor(prior, req.where(~late)))

    def score(batch: DataFrame) -> DataFrame:
        own = batch.sparkSession.read  # a micro-batch has a session of its own
        return RQ.score_requests(batch, own.parquet(prior.shared_path), own.parquet(factor.shared_path))

    return late, score


PROCESSED = ["event_id", "batch_no", "success", "raw_prediction", "ctr_prediction", "ctr_category", "recommendation"]


def processed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P6 over the request table: scored, post-processed per 15,000 requests."""
    late, score = ad_prior_scorer(spark, sf_dir)
    return M.round_doubles(RQ.process_batches(score(V.requests(spark, sf_dir).where(late))).select(PROCESSED), 9)


def stream_processed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 + P6: the same on the request stream, equal to :func:`processed_requests`."""
    late, score = ad_prior_scorer(spark, sf_dir)
    out = processed_stream(V.requests_from_events(event_stream(spark, sf_dir)).where(late), score)
    return M.round_doubles(out.select(PROCESSED), 9)


#: Pieces of a model's serving state; a model may have any share of all requests.
SHARDS = 16
COUNTERS = "total long, successful long, processed long, raised long, mean double, m2 double"
RECENT = "micros array<long>, ids array<long>, preds array<double>"


def _serving_update(recent: int):
    """The state's step: counters, Welford's mean and squares of the adjustments,
    and the ``recent`` latest successful predictions; a batch at a time."""

    def step(key, frames, state):
        n, ok, processed, raised, mean, m2, micros, ids, preds = state.get if state.exists else (0, 0, 0, 0, 0.0, 0.0, [], [], [])
        micros, ids, preds = np.array(micros, np.int64), np.array(ids, np.int64), np.array(preds, float)
        for f in frames:
            change = (f["ctr_prediction"] - f["raw_prediction"]).to_numpy(float)
            own, own_mean = len(change), change.mean()
            shift = own_mean - mean
            m2 += float(((change - own_mean) ** 2).sum()) + shift * shift * n * own / (n + own)
            mean += shift * own / (n + own)
            n += own
            good = f["success"].to_numpy(bool)
            ok, processed, raised = ok + int(good.sum()), processed + int(f["postprocessing_applied"].sum()), raised + int((change > 0).sum())
            micros, ids, preds = (np.append(a, f.loc[good, c].to_numpy(a.dtype)) for a, c in
                                  ((micros, "micros"), (ids, "event_id"), (preds, "ctr_prediction")))
            last = np.lexsort((ids, micros))[-recent:]
            micros, ids, preds = micros[last], ids[last], preds[last]
        new = (n, ok, processed, raised, float(mean), float(m2), micros.tolist(), ids.tolist(), preds.tolist())
        state.update(new)
        yield pd.DataFrame([(*key, *new)], columns=["model_used", "shard", "total", "successful", "processed", "raised", "mean", "m2",
                                                    "micros", "ids", "preds"])

    return step


def serving_state(scored: DataFrame, recent: int = 1000, name: str = "serving") -> DataFrame:
    """W7 + G27 on a stream: keyed state per (model, shard), where the shard is a
    hash of the request, so that no model's requests have to meet in one task. A
    micro-batch's changed states go to a folder named by its batch id, which a
    replay writes anew. Returns the latest state of each piece."""
    spark = scored.sparkSession
    base = f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex[:12]}"
    s = scored.select("model_used", F.pmod(F.xxhash64("event_id"), F.lit(SHARDS)).cast("int").alias("shard"),
                      F.unix_micros(X.ntz_as_utc(F.col("ts"))).alias("micros"), "event_id", "ctr_prediction", "raw_prediction",
                      "success", "postprocessing_applied")
    states = s.groupBy("model_used", "shard").applyInPandasWithState(
        _serving_update(recent), f"model_used string, shard int, {COUNTERS}, {RECENT}", f"{COUNTERS}, {RECENT}", "update",
        GroupStateTimeout.NoTimeout)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch_id={batch_id}")

    states.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{base}/chk") \
        .trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    fields = [c for c in out.columns if c not in ("model_used", "shard", "batch_id")]
    return out.groupBy("model_used", "shard").agg(F.max_by(F.struct(*fields), "batch_id").alias("s")).select("model_used", "shard", "s.*")


def merged_stats(states: DataFrame, recent: int = 1000) -> DataFrame:
    """The pieces' states merged per model: the columns of ``requests.serving_stats``."""
    of = states.groupBy("model_used")
    whole = of.agg(F.sum("total").alias("total_requests"), F.sum("successful").alias("successful_predictions"),
                   F.sum("processed").alias("__processed"), F.sum("raised").alias("positive_adjustments"),
                   (F.sum(F.col("total") * F.col("mean")) / F.sum("total")).alias("avg_adjustment"))
    spread = states.join(F.broadcast(whole.select("model_used", "avg_adjustment")), "model_used").groupBy("model_used").agg(  # a row a model
        F.sum(F.col("m2") + F.col("total") * (F.col("mean") - F.col("avg_adjustment")) ** 2).alias("__m2"))
    latest = states.select("model_used", F.explode(F.arrays_zip("micros", "ids", "preds")).alias("r")).select("model_used", "r.*")
    latest = RQ.recent_rows(latest, ["model_used"], recent, ["micros", "ids"])
    seen = latest.groupBy("model_used").agg(F.avg("preds").alias("ctr_mean"), F.stddev_pop("preds").alias("ctr_std"),
                                            F.min("preds").alias("ctr_min"), F.max("preds").alias("ctr_max"))
    n = F.col("total_requests")
    return whole.join(spread, "model_used").join(seen, "model_used", "left").select(
        "model_used", "total_requests", "successful_predictions", (n - F.col("successful_predictions")).alias("failed_predictions"),
        (F.col("__processed") / n).alias("postprocessing_rate"), "avg_adjustment", F.sqrt(F.col("__m2") / n).alias("adjustment_std"),
        "positive_adjustments", (F.col("successful_predictions") / n).alias("success_rate"),
        ((n - F.col("successful_predictions")) / n).alias("failure_rate"), "ctr_mean", "ctr_std", "ctr_min", "ctr_max")


def stream_serving_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W7 + G27 from the stream's state, equal to the batch ``serving_stats``."""
    return M.round_doubles(merged_stats(serving_state(scored_stream(spark, sf_dir))), 9)
