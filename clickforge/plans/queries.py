"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per
operator group of SURVEY §2, each reading the given tables in full."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickforge.session import materialize as materialize_table

from clickforge.operators import metrics as M
from clickforge.session import ensure_checkpoint_dir
from clickforge.sources import views as V

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    """Register a query; every registered query first makes sure the session
    has a checkpoint folder (the configured one, or a local scratch folder
    when running in local mode without one)."""
    def deco(fn: Query) -> Query:
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_checkpoint_dir(spark)
            return fn(spark, sf_dir)
        REGISTRY[name] = run
        return fn
    return deco


# ---------------------------------------------------------------- metrics
@register("metrics_by_model")
def metrics_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G22 per model over the long prediction table."""
    return M.metric_row(V.long_predictions(spark, sf_dir), ["model"], bounded=True)


@register("metrics_by_segment")
def metrics_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G22 per (model, segment): the grouped form of the metric record."""
    return M.metric_row(V.long_predictions(spark, sf_dir), ["model", "segment"])


# ------------------------------------------------------- detection / schema
from clickforge.operators import detect as D  # noqa: E402
from clickforge.operators import encode as E  # noqa: E402
from clickforge.plans import features as FE  # noqa: E402
from clickforge.sources.tables import read_table  # noqa: E402


@register("label_detection")
def label_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G5/G6 on the ``labels`` table: stage 2 rejects ``quality`` on its rate,
    stage 3 picks ``toxic``."""
    return D.label_candidates(read_table(spark, sf_dir, "labels"))


@register("label_detection_impressions")
def label_detection_impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G5/G6 over every column of the impression table (stage 1 finds ``clicked``)."""
    return D.label_candidates(V.impressions(spark, sf_dir))


@register("feature_types")
def feature_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B4 (+ G4 exact distinct counts for name-matched columns)."""
    return D.feature_types(V.impressions(spark, sf_dir))


def _split_col():
    return F.when(V.is_test_row(), "test").otherwise("train").alias("split")


def _fit(spark: SparkSession, sf_dir: str):
    imp = V.impressions(spark, sf_dir)
    tr, te = V.split_train_test(imp)
    return FE.fit(tr, te)


@register("category_normalize")
def category_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categorical columns to int32 codes ('.0' stripping, -1 default)."""
    imp = V.impressions(spark, sf_dir)
    cats = [c for c in D.EXPECTED_CATEGORICAL]
    from clickforge.functions import exprs as X
    return imp.select("row_key", _split_col(), *[X.category_int(F.col(c)).alias(c) for c in cats])


@register("frequency_codes")
def frequency_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1 + S1/S2: frequency code table over train ∪ test values."""
    fm, _, _ = _fit(spark, sf_dir)
    return fm.codes.select("column_name", "value", F.col("train_count").cast("long").alias("train_count"),
                           "code")


@register("target_encoding")
def target_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 fit table (G1, G2, J5): smoothed in-sample click rate per code."""
    fm, _, _ = _fit(spark, sf_dir)
    return fm.target_enc.select("column_name", "value", "n", F.round("mean", 6).alias("mean"),
                                F.round("enc", 6).alias("enc"))


@register("cross_codes")
def cross_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W2 + X-4: interaction codes, fitted per table (reference behaviour)."""
    fm, ctr, cte = _fit(spark, sf_dir)
    a = E.fit_cross_codes(ctr).select(F.lit("train").alias("split"), "*")
    b = E.fit_cross_codes(cte).select(F.lit("test").alias("split"), "*")
    return a.unionByName(b)


@register("feature_matrix")
def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the full feature table for train and test (B1-B11, W1, F1, W2, X-1..X-3)."""
    imp = V.impressions(spark, sf_dir)
    tr, te = V.split_train_test(imp)
    _, a, b = FE.build_features(tr, te)
    return a.select("row_key", F.lit("train").alias("split"), *a.columns[1:]) \
        .unionByName(b.select("row_key", F.lit("test").alias("split"), *b.columns[1:]))


# ------------------------------------------------- metrics, folds, scoring
from clickforge.operators import calibrate as CAL  # noqa: E402
from clickforge.operators import compare as CMP  # noqa: E402
from clickforge.operators import ensemble as ENS  # noqa: E402
from clickforge.operators import split as SPL  # noqa: E402


@register("leaderboard")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1: metric record per model ranked by combined score."""
    return CMP.leaderboard(V.long_predictions(spark, sf_dir))


@register("best_model")
def best_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2: best model by AUC."""
    mr = M.metric_row(V.long_predictions(spark, sf_dir), ["model"], bounded=True)
    return CMP.best_by(mr, "auc")


@register("ap_rowwise")
def ap_rowwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision at every positive, ties broken by row key."""
    return M.ap_rowwise(V.long_predictions(spark, sf_dir), ["model"], bounded=True)


@register("loss_metrics")
def loss_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log losses, competition and combined scores per model."""
    sc = M.score_counts(V.long_predictions(spark, sf_dir), ["model"])
    ap = M.ranking_from_counts(sc, ["model"], bounded=True)
    return M.loss_metrics(None, ["model"], with_ap=ap, counts=sc)


@register("prediction_summary")
def prediction_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, population std, min, max per model."""
    return M.prediction_summary(V.long_predictions(spark, sf_dir), ["model"])


@register("class_weights")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1, G8, G9 per split."""
    imp = V.impressions(spark, sf_dir).withColumn("split", _split_col())
    return M.round_doubles(M.class_weights(imp, "clicked", ["split"]), 6)


@register("click_rate_by_value")
def click_rate_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2 + G3: click rate and count per raw category value of the train split."""
    tr, _ = V.split_train_test(V.impressions(spark, sf_dir))
    lv = E.long_values(tr, D.EXPECTED_CATEGORICAL, extra=["clicked"])
    return lv.groupBy("column_name", "value").agg(
        F.count(F.lit(1)).alias("n"), F.count("clicked").alias("n_labelled"),
        F.round(F.avg(F.col("clicked").cast("double")), 6).alias("ctr"))


@register("stratified_folds")
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """5 stratified folds in md5(row_key || 42) order."""
    imp = V.impressions(spark, sf_dir).select("row_key", "clicked")
    return SPL.stratified_folds(imp, "clicked", 5, 42)


@register("stratified_holdout")
def stratified_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """80/20 split per class."""
    imp = V.impressions(spark, sf_dir).select("row_key", "clicked")
    return SPL.stratified_holdout(imp, "clicked", 0.2, 42)


@register("generated_ids")
def generated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TEST_%07d ids for the test split in key order."""
    _, te = V.split_train_test(V.impressions(spark, sf_dir).select("row_key"))
    return SPL.generated_ids(te)


@register("ctr_correction")
def ctr_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-17: two-pass rescale of model 1 scores to the 0.0191 click rate."""
    pr = V.predictions(spark, sf_dir).select("row_key", F.col("p_m1").alias("p"))
    out = CAL.ctr_correction(pr, "p")
    return out.select("row_key", F.round("p_corrected", 9).alias("p_corrected"), "ctr_ok")


@register("prediction_quantiles")
def prediction_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1 inputs: exact 1st/50th/99th percentiles per model (linear interpolation)."""
    q = CAL.exact_quantiles(V.long_predictions(spark, sf_dir), "p", [0.01, 0.5, 0.99], ["model"])
    return M.round_doubles(q.select("model", F.col("q0").alias("p01"), F.col("q1").alias("p50"),
                                    F.col("q2").alias("p99")), 9)


@register("post_process")
def post_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4 with P2 off: outlier clip -> CTR alignment (0.0201) -> clip, model 2."""
    pr = V.predictions(spark, sf_dir).select("row_key", F.col("p_m2").alias("p"))
    out = CAL.post_process(pr, "p", diversity=False)
    return out.select("row_key", F.round("p", 9).alias("p"))


@register("submission")
def submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test-split scores (model 3) corrected to 0.0191 with generated ids."""
    pr = V.predictions(spark, sf_dir)
    _, te = V.split_train_test(pr.select("row_key", F.col("p_m3").alias("p")))
    c = CAL.ctr_correction(te, "p")
    ids = SPL.generated_ids(c)
    return ids.select("ID", F.round("p_corrected", 9).alias("clicked"))


@register("ensemble_weights")
def ensemble_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Performance, bias-penalised and CTR-corrected weights."""
    long = V.long_predictions(spark, sf_dir)
    return M.round_doubles(ENS.weight_table(ENS.model_scores(long)), 6)


@register("ensemble_strategies")
def ensemble_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strategy scores and the chosen strategy."""
    wide = V.predictions(spark, sf_dir).drop("segment")
    return ENS.strategy_selection(wide, list(V.MODEL_COLUMNS))


@register("comparison_report")
def comparison_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary over the model comparison."""
    mr = M.metric_row(V.long_predictions(spark, sf_dir), ["model"], bounded=True)
    return M.round_doubles(CMP.comparison_summary(mr), 6)


# ------------------------------------------------------- requests / serving
from clickforge.operators import requests as RQ  # noqa: E402


def scored_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later requests scored by a prior of earlier ones; ads that are new by then
    have no prior and fail."""
    req = V.requests(spark, sf_dir)
    late = RQ.time_cut(req)
    # fitted state (one row per ad, one scalar row) is checkpointed once
    prior = materialize_table(RQ.fit_ad_prior(req.where(~late)))
    factor = materialize_table(RQ.alignment_factor(prior, req.where(~late)))
    return RQ.score_requests(req.where(late), prior, factor)


@register("request_features")
def request_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5 with X-6..X-12 and X-18 over every request."""
    return RQ.request_features(V.requests(spark, sf_dir))


@register("request_responses")
def request_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P6 / X-13..X-16: aligned scores and decision fields per request."""
    return M.round_doubles(scored_requests(spark, sf_dir), 9)


@register("response_records")
def response_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-19: the nested response record of each request, read back by field."""
    r = scored_requests(spark, sf_dir)
    r = r.select("event_id", RQ.response_struct(r).alias("r"))
    return M.round_doubles(r.select("event_id", "r.ctr_prediction", "r.predicted_click", "r.ctr_category", "r.recommendation",
                                    "r.processing_pipeline.model_used", "r.processing_pipeline.postprocessing_applied",
                                    "r.model_info.model_name", "r.model_info.version", "r.performance.timestamp"), 9)


@register("serving_stats")
def serving_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G27 + W7: serving statistics with the last 1000 predictions."""
    return M.round_doubles(RQ.serving_stats(scored_requests(spark, sf_dir)), 9)


@register("api_usage")
def api_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call counts, error count, success rate and decision usage rates."""
    r = scored_requests(spark, sf_dir).withColumn("shown", F.col("recommendation") == "show")
    return M.round_doubles(RQ.api_usage(r, ["shown", "postprocessing_applied"]), 9)


@register("api_usage_pipeline")
def api_usage_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full and partial pipeline counts, observed while the calls are scored and written."""
    i = F.col("event_id")
    calls = scored_requests(spark, sf_dir).withColumns(
        {"use_calibration": i % 4 != 1, "use_ensemble": i % 5 != 2, "use_postprocessing": F.when(i % 6 != 0, i % 3 != 0)})
    out, seen = RQ.observed_usage(RQ.pipeline_flags(calls), RQ.PIPELINE_FLAGS)
    return M.round_doubles(RQ.usage_report(materialize_table(out), seen, RQ.PIPELINE_FLAGS), 9)


@register("open_context_features")
def open_context_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-12, X-18: every feature of requests with unknown context keys, a row each."""
    found = RQ.open_features(V.context_requests(spark, sf_dir))
    return found.select("event_id", F.explode("features").alias("feature", "value"))


@register("context_keys")
def context_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-12: the keys that request contexts hold."""
    return RQ.context_keys(V.context_requests(spark, sf_dir))


@register("recent_predictions")
def recent_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 1000 most recent responses (a top-k report)."""
    r = scored_requests(spark, sf_dir)
    return M.round_doubles(RQ.recent_rows(r, [], 1000, ["ts", "event_id"])
                           .select("event_id", "ts", "ctr_prediction", "ctr_category"), 9)


# ---------------------------------------------------------------- streaming
from clickforge.streaming import serving as ST  # noqa: E402

register("stream_scoring")(ST.stream_scoring)
register("stream_window_stats")(ST.stream_window_stats)
register("processed_requests")(ST.processed_requests)
register("stream_processed_requests")(ST.stream_processed_requests)
register("stream_serving_stats")(ST.stream_serving_stats)


# -------------------------------------------------------- models (rows-only)
from clickforge.operators import ensemble as _ens  # noqa: E402
from clickforge.plans import models as ML  # noqa: E402


def _train_features(spark: SparkSession, sf_dir: str):
    imp = V.impressions(spark, sf_dir)
    tr, te = V.split_train_test(imp)
    fm, a, b = FE.build_features(tr, te, keep_label=True)
    # training reads the rows several times (weights, folds, sizes): the features are computed once
    return fm, materialize_table(a), b


@register("cv_folds")
def cv_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5 + M4 + G18 + G24: 5-fold CV of boosted trees; per-fold scores and
    the refit round count (M6)."""
    fm, a, _ = _train_features(spark, sf_dir)
    folds, _ = ML.cross_validate(a, fm.feature_order, k=5)
    folds = materialize_table(folds)
    rounds = ML.refit_rounds(folds)
    # M6: final model on all training rows with the mean best iteration
    final = ML.refit(a, fm.feature_order, rounds)
    summary = CMP.fold_summary(folds.withColumn("model", F.lit("gbt_a")),
                               ["competition_score", "ap", "balanced_log_loss"]).drop("model")
    return M.round_doubles(folds.withColumn("refit_rounds", F.lit(rounds))
                           .withColumn("refit_trees", F.lit(final.getNumTrees))
                           .crossJoin(F.broadcast(summary)), 6)


@register("model_comparison")
def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1-M3, M7, M8, L1: holdout comparison of two GBT presets and LR."""
    fm, a, _ = _train_features(spark, sf_dir)
    return ML.compare_models(a, fm.feature_order)


@register("trained_submission")
def trained_submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training run end to end (rows-only): features, early-stopped holdout,
    M6 refit on all rows, scores of the test side, X-17, W5, CSV and back."""
    fm, a, b = _train_features(spark, sf_dir)
    rounds = ML.holdout_rounds(a, fm.feature_order)
    model = ML.refit(a, fm.feature_order, rounds)
    scored = materialize_table(ML.score_table(model, b, fm.feature_order))
    corrected = CAL.ctr_correction(scored, "p")
    out = SPL.generated_ids(corrected).select("ID", F.col("p_corrected").alias("clicked"))
    path = f"{checkpoint_dir(spark).rstrip('/')}/submissions/{uuid.uuid4().hex[:12]}"
    TB.write_submission(out, path)
    return TB.read_id_template(spark, path)


@register("isotonic_calibration")
def isotonic_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W8 + M12: isotonic calibration fitted on the out-of-fold scores of the
    cross-validation, with the metric record (G22) before and after."""
    fm, a, _ = _train_features(spark, sf_dir)
    _, oof = ML.cross_validate(a, fm.feature_order, k=5)
    cal = ML.isotonic_calibration(oof)
    long = cal.select(F.lit("raw").alias("model"), F.col("__y").alias("clicked"), "p").unionByName(
        cal.select(F.lit("isotonic").alias("model"), F.col("__y").alias("clicked"),
                   F.col("p_calibrated").alias("p")))
    return M.metric_row(long, ["model"], bounded=True)


@register("stacking_oof")
def stacking_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W8 + E7: base models' out-of-fold scores, the meta-learner fitted on them,
    and the metric record (G22) of each."""
    fm, a, _ = _train_features(spark, sf_dir)
    fits = ML.base_fits(rounds=10)
    wide = materialize_table(ML.stacking_oof(a, fm.feature_order, fits))
    long = wide.unpivot(["row_key", "clicked"], [*fits, "p_stack"], "model", "p")
    return M.metric_row(long, ["model"], bounded=True)


@register("stacking_ensemble")
def stacking_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E7 + E8 + E10: stacking meta-learner and the two-level ensemble with
    fallback, evaluated per ensemble."""
    wide = V.predictions(spark, sf_dir).drop("segment").where(F.col("clicked").isNotNull())
    models = list(V.MODEL_COLUMNS)
    st = materialize_table(ML.stacking(wide, models))  # scored once, for four metric records
    strat = _ens.strategy_selection(wide, models)
    best = strat.where("selected").select("strategy", "combined_score")
    weights = _ens.weight_table(_ens.model_scores(_ens.to_long(wide, models, ["row_key", "clicked"])))
    sp = _ens.strategy_predictions(st, models, weights)
    chosen = best.first()
    dyn_col = chosen["strategy"] if chosen else "simple_average"
    sc_stack = M.metric_row(st.select(F.lit("stacking").alias("model"), "clicked", F.col("p_stack").alias("p")),
                            ["model"], bounded=True).select("combined_score").first()["combined_score"]
    sc_dyn = chosen["combined_score"] if chosen else 0.0
    two = _ens.two_level(F.col("p_stack"), F.lit(sc_stack), F.col(dyn_col), F.lit(sc_dyn))
    p_final, src = _ens.with_fallback(two, F.col(models[0]))
    long = sp.select("clicked", F.lit("stacking").alias("model"), F.col("p_stack").alias("p")).unionByName(
        sp.select("clicked", F.lit("dynamic").alias("model"), F.col(dyn_col).alias("p"))).unionByName(
        sp.select("clicked", F.lit("main").alias("model"), p_final.alias("p")))
    return M.metric_row(long, ["model"], bounded=True)


# ------------------------------------------------------ experiment tracking
import uuid  # noqa: E402

from clickforge.session import checkpoint_dir  # noqa: E402
from clickforge.sources import experiments as EXP  # noqa: E402


def _experiment_runs(spark: SparkSession, sf_dir: str):
    lp = V.long_predictions(spark, sf_dir)
    tr = lp.where(~V.is_test_row())
    runs = []
    for name, src in (("all_rows", lp), ("train_split", tr)):
        mr = M.metric_row(src, ["model"], bounded=True, digits=None)
        stats = M.prediction_summary(src.where(F.col("model") == "m3"), [], digits=None)
        runs.append((name, {"models": "m1,m2,m3", "rows": name}, mr, stats))
    folder = f"{checkpoint_dir(spark).rstrip('/')}/experiments/{uuid.uuid4().hex[:12]}"
    return EXP.log_and_parse(runs, folder, spark)


def _request_model(spark: SparkSession, sf_dir: str):
    """Model and alignment factor from the earlier requests; whether a request is a later one."""
    req = V.requests(spark, sf_dir)
    late = RQ.time_cut(req)
    early = materialize_table(ML.request_rows(req.where(~late)))  # features computed once, for the fit and the factor
    model, names = ML.fit_request_rows(early)
    return model, names, ML.request_alignment(ML.score_request_rows(early, model, names)), late


@register("request_model_scores")
def request_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P6 with F5 and a fitted model (rows-only): later requests, post-processed
    with the factor of the earlier ones."""
    model, names, factor, late = _request_model(spark, sf_dir)
    return ML.score_requests(V.requests(spark, sf_dir).where(late), model, names, factor)


@register("stream_model_scores")
def stream_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 with F5 and ``model.transform`` on the request stream (rows-only)."""
    model, names, factor, late = _request_model(spark, sf_dir)
    req = V.requests_from_events(ST.event_stream(spark, sf_dir)).where(late)
    return ST._run_to_table(ML.score_requests(req, model, names, factor), "model_scoring")


@register("experiment_log")
def experiment_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1 + A11 + O4 + A12: log two evaluation runs to the experiment table and
    text log, then parse the text back into per-model rows."""
    return _experiment_runs(spark, sf_dir).drop("ts", "notes", "execution_time")


@register("experiment_summary")
def experiment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O3 + L3 + L4: count, best experiment by first AUC, latest experiment."""
    parsed = materialize_table(_experiment_runs(spark, sf_dir))
    cnt = parsed.agg(F.countDistinct("experiment_num").alias("n_experiments"))
    best = EXP.best_experiment(parsed)
    latest = EXP.recent_experiments(parsed, 1).select(F.col("experiment_num").alias("latest_experiment"))
    return cnt.crossJoin(best).crossJoin(latest)


# ------------------------------------------------- sources, checks, scoring
from clickforge.operators import clean as CL  # noqa: E402
from clickforge.sources import tables as TB  # noqa: E402


@register("sample_rows")
def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: exact-n reproducible sample (1000 rows by md5(row_key || 42))."""
    return TB.sample_rows(V.impressions(spark, sf_dir), 1000, "row_key", 42)


@register("dataset_check")
def dataset_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2 + A6: row counts and sizes of the two input tables against the expected ones."""
    tables = {"train": read_table(spark, sf_dir, "lineitem"), "test": read_table(spark, sf_dir, "events")}
    TB.load_pair(tables["train"], tables["test"])
    chk = TB.dataset_check(tables, {"train": TB.EXPECTED_TRAIN_ROWS, "test": TB.EXPECTED_TEST_ROWS},
                           {"train": TB.MIN_TRAIN_MB << 20, "test": TB.MIN_TEST_MB << 20})
    return chk.select("table_name", "row_count", "rows_ok", "size_ok")


@register("alignment_check")
def alignment_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test-split predictions against all labelled impressions, by key."""
    pr = V.predictions(spark, sf_dir).where(V.is_test_row()).select("row_key")
    return CL.alignment_check(pr, V.impressions(spark, sf_dir).select("row_key"))


@register("distinct_counts")
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact distinct non-null values of every impression column."""
    imp = V.impressions(spark, sf_dir)
    return D.column_stats(imp, distinct_for=imp.columns).select("column_name", "non_null", "n_distinct")


@register("minimal_features")
def minimal_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric columns common to train and test, NULL -> 0."""
    tr, te = V.split_train_test(V.impressions(spark, sf_dir))
    a, b = CL.minimal_features(tr, te.drop("clicked"), "clicked")
    return a.withColumn("split", F.lit("train")).unionByName(b.withColumn("split", F.lit("test")))


@register("basic_features")
def basic_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned and frequency-coded features without derived columns."""
    tr, te = V.split_train_test(V.impressions(spark, sf_dir))
    a, b = FE.basic_features(tr, te)
    return a.select("row_key", F.lit("train").alias("split"), *a.columns[1:]) \
        .unionByName(b.select("row_key", F.lit("test").alias("split"), *b.columns[1:]))


@register("table_scoring")
def table_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: test-split scores post-processed per 80,000-row batch, then the
    global rescale; P2 noise off so the result is deterministic."""
    te = V.predictions(spark, sf_dir).where(V.is_test_row()).select("row_key", F.col("p_m2").alias("p"))
    out = CAL.table_scoring(te, "p", batch_size=80000, diversity=False)
    return out.select("row_key", "batch_id", F.round("p", 9).alias("p"))


@register("diversity_noise")
def diversity_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2 in P4: noise (from the row key) for a model with < 1000 distinct scores."""
    pr = V.predictions(spark, sf_dir).select("row_key", F.col("p_m1").alias("p"))
    return M.round_doubles(CAL.post_process(pr, "p", diversity=True, seed=7), 9)


@register("submission_csv")
def submission_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9 + A8: write the submission as CSV to the shared folder, read it
    back through the template schema."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/submissions/{uuid.uuid4().hex[:12]}"
    TB.write_submission(REGISTRY["submission"](spark, sf_dir), path)
    return TB.read_id_template(spark, path)


@register("evaluation_report")
def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O5 + A10: the comparison report written as JSON to the shared folder
    and read back with its declared schema."""
    rep = comparison_report(spark, sf_dir)
    path = f"{checkpoint_dir(spark).rstrip('/')}/reports/{uuid.uuid4().hex[:12]}"
    TB.write_report(rep, path)
    return spark.read.schema(rep.schema).json(path)


@register("experiment_export")
def experiment_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experiments exported as one JSON object each (model results
    nested), read back and flattened."""
    lp = V.long_predictions(spark, sf_dir)
    mr = M.metric_row(lp, ["model"], bounded=True, digits=None)
    folder = f"{checkpoint_dir(spark).rstrip('/')}/experiments/{uuid.uuid4().hex[:12]}"
    EXP.append_experiment(EXP.experiment_rows(mr, 1, "all_rows", {"models": "m1,m2,m3"}), f"{folder}/table")
    EXP.export_json(spark.read.parquet(f"{folder}/table"), f"{folder}/json")
    js = spark.read.json(f"{folder}/json")
    return js.select("experiment_num", "run_model", F.explode("model_performances").alias("m")) \
        .select(F.col("experiment_num").cast("int").alias("experiment_num"), "run_model", "m.*") \
        .transform(M.round_doubles, 9)


@register("scoring_features")
def scoring_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B8 + B10 + B11 + B12: test-side features aligned to the training
    column order with score-time cleaning (NaN -> 0, ±inf -> ±1e6)."""
    imp = V.impressions(spark, sf_dir)
    tr, te = V.split_train_test(imp)
    fm, _, b = FE.build_features(tr, te)
    b = CL.finite_clean(b, cols=fm.feature_order, mode="score")
    return CL.align_features(b, fm.feature_order).select("row_key", F.lit("test").alias("split"),
                                                          *fm.feature_order)


# ------------------------------------------------- hard rows and small items
def _dirty_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long predictions in which some scores are NaN, infinite or NULL."""
    lp = V.long_predictions(spark, sf_dir)
    seg = F.col("segment")
    bad = (F.when((F.col("model") == "m1") & (seg == "3"), F.lit(float("nan")))
           .when((F.col("model") == "m1") & (seg == "4"), F.lit(None).cast("double"))
           .when((F.col("model") == "m2") & (seg == "1"), F.lit(float("inf")))
           .when((F.col("model") == "m2") & (seg == "2"), F.lit(float("-inf"))).otherwise(F.col("p")))
    return lp.withColumn("p", bad)


@register("leaderboard_repaired")
def leaderboard_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1 + B16: models with NaN, infinite and NULL scores are repaired, not lost."""
    return CMP.leaderboard(_dirty_predictions(spark, sf_dir))


@register("metrics_unrepaired")
def metrics_unrepaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G22 on the same rows without repair: the reference's defaults for such models."""
    return M.metric_row(_dirty_predictions(spark, sf_dir), ["model"], bounded=True)


@register("missing_column_features")
def missing_column_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column that the test side lacks is 0.0 on both sides."""
    tr, te = V.split_train_test(V.impressions(spark, sf_dir))
    a, b = FE.basic_features(tr, te.drop("feat_a_2"))
    pick = lambda d, s: d.select("row_key", F.lit(s).alias("split"), "feat_a_1", "feat_a_2", "hour")
    return pick(a, "train").unionByName(pick(b, "test"))


@register("cleaned_values")
def cleaned_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B9 and B10 on NaN, infinite and NULL values."""
    imp = V.impressions(spark, sf_dir)
    v = (F.when(F.col("age_group") == "1", F.lit(float("nan"))).when(F.col("age_group") == "2", F.lit(float("inf")))
         .when(F.col("age_group") == "3", F.lit(float("-inf"))).when(F.col("age_group") == "4", F.lit(None).cast("double"))
         .otherwise(F.col("feat_a_3")))
    d = imp.select("row_key", v.alias("train_value"), v.alias("score_value"))
    d = CL.finite_clean(d, cols=["train_value"], mode="train")
    return CL.finite_clean(d, cols=["score_value"], mode="score").select("row_key", "train_value", "score_value")


@register("ensemble_main")
def ensemble_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E8 + E10: two sub-ensembles with given scores, and where they have no
    score the first model's, else the constant, each with its source."""
    seg = F.col("segment")
    d = V.predictions(spark, sf_dir).select(
        "row_key", F.when(seg != "5", F.col("p_m1")).alias("p_stack"), F.when(seg != "6", F.col("p_m2")).alias("p_dyn"),
        F.when((seg != "6") | (F.col("p_m3") > 0.02), F.col("p_m3")).alias("p_first"))
    two = _ens.two_level(F.col("p_stack"), F.lit(0.3), F.col("p_dyn"), F.lit(0.2))
    p, source = _ens.with_fallback(two, F.col("p_first"))
    zero = _ens.two_level(F.col("p_stack"), F.lit(0.0), F.col("p_dyn"), F.lit(0.0))
    return d.select("row_key", F.round(p, 12).alias("p"), source.alias("source"), F.round(zero, 12).alias("p_equal"))


@register("keyed_metrics")
def keyed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prediction table and a label table joined by key, then G22."""
    scores = V.predictions(spark, sf_dir).select("row_key", F.col("p_m2").alias("p"))
    labels = V.impressions(spark, sf_dir).where(V.is_test_row()).select("row_key", "clicked")
    return M.metric_row(scores.join(labels, "row_key").withColumn("model", F.lit("m2")), ["model"], bounded=True)


@register("submission_template")
def submission_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4 + A8 + P7: corrected scores in key order, paired with the ids of a
    template in file order. (The template is written here in ranges of ids, a file each.)"""
    _, te = V.split_train_test(V.predictions(spark, sf_dir).select("row_key", F.col("p_m3").alias("p")))
    path = f"{checkpoint_dir(spark).rstrip('/')}/templates/{uuid.uuid4().hex[:12]}"
    ids = SPL.generated_ids(te, fmt="T-%09d").select("ID", F.lit(0.0).alias("clicked"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    TB.write_submission(ids.repartitionByRange(ranges, "ID").sortWithinPartitions("ID"), path)
    out = SPL.attach_template_ids(CAL.ctr_correction(te, "p"), TB.read_id_template(spark, path))
    return out.select("row_key", "ID", F.round("p_corrected", 9).alias("clicked"))


@register("label_confirmation")
def label_confirmation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The provided label, the first candidate that is binary, and the default."""
    imp = V.impressions(spark, sf_dir)
    cases = [("provided", D.confirm_label(imp)), ("candidate", D.confirm_label(imp.withColumnRenamed("clicked", "target"))),
             ("default", D.confirm_label(imp.drop("clicked"), provided="seq"))]
    out = None
    for name, d in cases:
        d = d.select(F.lit(name).alias("case_name"), "label")
        out = d if out is None else out.unionByName(d)
    return out


@register("fold_metrics_summary")
def fold_metrics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and population std over folds (here: segments) per model."""
    mr = M.metric_row(V.long_predictions(spark, sf_dir), ["model", "segment"], digits=None)
    return M.round_doubles(CMP.fold_summary(mr, ["weighted_log_loss", "predicted_ctr"]), 6)


@register("training_report")
def training_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages over the trained models and the calibrated share."""
    mr = M.metric_row(V.long_predictions(spark, sf_dir), ["model"], bounded=True, digits=None)
    return M.round_doubles(CMP.training_summary(mr.withColumn("calibrated", F.col("model") == "m3")), 6)


@register("batches_by_name")
def batches_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: batches with different columns joined by name; what a batch lacks is NULL."""
    tr, te = V.split_train_test(V.impressions(spark, sf_dir))
    both = tr.select("row_key", "feat_a_1", "clicked").unionByName(te.select("feat_a_2", "row_key"), allowMissingColumns=True)
    return both.select("row_key", "feat_a_1", "feat_a_2", "clicked")


@register("default_predictions")
def default_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The constants for failed models and failed requests."""
    p = F.when(F.col("segment") != "2", F.col("p_m1"))
    return V.predictions(spark, sf_dir).select(
        "row_key", F.round(CL.default_prediction(p), 9).alias("trained"),
        F.round(CL.default_prediction(p, CL.SERVING_BASELINE), 9).alias("served"))
