"""Request featurisation, scoring responses and serving statistics
(SURVEY F5, X-6..X-19, P6, G27, G28, W7) over a request *table* — the same
functions run unchanged on a request stream (see ``clickforge.streaming``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from clickforge.functions import exprs as X
from clickforge.operators.ranking import join_small, laid_out

# Fixed values from the reference request scorer.
DEFAULT_FEATURES = {
    "feat_e_1": 65.0, "feat_e_3": 5.0, "feat_e_4": -0.05, "feat_e_5": -0.02,
    "feat_e_6": -0.04, "feat_e_7": 21.0, "feat_e_8": -172.0, "feat_e_9": -10.0,
    "feat_e_10": -270.0, "feat_d_1": 0.39, "feat_d_2": 1.93, "feat_d_3": 1.76,
    "feat_d_4": 6.0, "feat_d_5": -0.29, "feat_d_6": -0.41,
    "feat_c_1": 0.0, "feat_c_2": 0.0, "feat_c_3": 0.0, "feat_c_4": 0.0,
    "feat_c_5": 0.0, "feat_c_6": 0.0, "feat_c_7": 0.0, "feat_c_8": 0.0,
    "feat_b_1": 0.0, "feat_b_2": 0.0, "feat_b_3": 0.0, "feat_b_4": 0.0,
    "feat_b_5": 0.0, "feat_b_6": 0.0,
}
DEVICE_CODES = {"mobile": 1, "desktop": 2, "tablet": 3, "unknown": 0}
PAGE_CODES = {"home": 1, "search": 2, "product": 3, "checkout": 4, "category": 5, "unknown": 0}
DAY_CODES = {"monday": 1, "tuesday": 2, "wednesday": 3, "thursday": 4, "friday": 5,
             "saturday": 6, "sunday": 7, "unknown": 0}
WEEKEND = ("saturday", "sunday")
DEFAULT_HOUR = 12
DEFAULT_POSITION = 1
USER_HASH_MOD, ID_ENC_MOD, PAIR_MOD, CONTEXT_MOD = 1_000_000, 10_000, 100_000, 1_000
BASELINE_CTR = 0.0201
BATCH_REQUESTS = 15_000
# CTR tiers: upper bounds (exclusive) and names
CTR_TIERS = [(0.01, "very_low"), (0.02, "low"), (0.05, "medium"), (0.1, "high")]
TOP_TIER = "very_high"
# Request columns the scorer reads as named context keys.
NAMED_CONTEXT = ("device", "page", "hour", "day_of_week", "position")


def code_lookup(c: Column, codes: dict[str, int]) -> Column:
    """Lower-cased literal map lookup, unseen or missing -> 0."""
    m = F.create_map(*[x for k, v in codes.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(m, F.lower(F.coalesce(c, F.lit("unknown")))), F.lit(0))


def day_name(ts: Column) -> Column:
    return F.lower(F.date_format(ts, "EEEE"))


def request_features(req: DataFrame, context_keys: Sequence[str] = ("bid_amount", "k"),
                     keep: Sequence[str] = ("event_id",), day_from_ts: bool = True) -> DataFrame:
    """F5 over a request table: X-18 defaults, X-6 md5 buckets, X-7 stable
    hash buckets (md5 form), J2 codes, X-8 day parts, X-9 weekend, X-10
    position, X-11 time of day of the *event*, X-12 other context keys; all
    float32. ``day_of_week`` comes from the event time when the request has
    no such field. A default feature that the request brings as a column of
    its own keeps the request's number."""
    cols = {k: F.coalesce(X.parse_number(F.col(k).cast("string")), F.lit(v)) if k in req.columns else F.lit(v)
            for k, v in DEFAULT_FEATURES.items()}
    u, a = F.col("user_id").cast("string"), F.col("ad_id").cast("string")
    cols["user_hash"] = X.md5_mod(u, USER_HASH_MOD)
    cols["user_id_encoded"] = X.md5_mod(u, ID_ENC_MOD)
    cols["ad_hash"] = X.md5_mod(a, USER_HASH_MOD)
    cols["ad_id_encoded"] = X.md5_mod(a, ID_ENC_MOD)
    cols["device_encoded"] = code_lookup(F.col("device"), DEVICE_CODES)
    cols["page_encoded"] = code_lookup(F.col("page"), PAGE_CODES)
    h = F.coalesce(F.col("hour"), F.lit(DEFAULT_HOUR))
    cols["hour"] = h
    cols["is_morning"] = ((h >= 6) & (h < 12)).cast("int")
    cols["is_afternoon"] = ((h >= 12) & (h < 18)).cast("int")
    cols["is_evening"] = ((h >= 18) & (h < 22)).cast("int")
    cols["is_night"] = ((h >= 22) | (h < 6)).cast("int")
    if "day_of_week" in req.columns:
        dow = F.col("day_of_week")
    else:
        dow = day_name(F.col("ts")) if day_from_ts else F.lit("unknown")
    cols["day_of_week_encoded"] = code_lookup(dow, DAY_CODES)
    cols["is_weekend"] = F.lower(F.coalesce(dow, F.lit("unknown"))).isin(*WEEKEND).cast("int")
    cols["user_ad_interaction"] = X.md5_mod(F.concat(u, F.lit("_"), a), PAIR_MOD)
    pos = F.coalesce(F.col("position"), F.lit(DEFAULT_POSITION))
    cols["session_position"] = pos
    cols["is_first_position"] = (pos == 1).cast("int")
    micros = F.unix_micros(X.ntz_as_utc(F.col("ts")))
    cols["time_index"] = F.pmod(micros, F.lit(86_400_000_000)) / 86_400_000_000.0
    for k in context_keys:
        c = F.col(k)
        num = X.parse_number(c.cast("string"))
        cols[f"context_{k}"] = F.coalesce(num, X.md5_mod(c.cast("string"), CONTEXT_MOD).cast("double"))
    return req.select(*keep, *[v.cast("float").alias(k) for k, v in cols.items()])


def context_values(context: Column) -> Column:
    """A request's context (JSON text) as a map of typed values; NULL or anything
    but a JSON object is an empty context."""
    return F.coalesce(F.try_parse_json(context).try_cast("map<string,variant>"), F.create_map().cast("map<string,variant>"))


def context_number(v: Column) -> Column:
    """X-12 of one value: a number, or text that reads as one, is itself; true
    and false are 1 and 0; null and any other text get their md5 bucket."""
    text = v.try_cast("string")
    hashed = X.md5_mod(F.coalesce(text, F.lit("None")), CONTEXT_MOD).cast("double")
    truth = F.when(F.schema_of_variant(v) == "BOOLEAN", v.try_cast("boolean").cast("double"))
    return F.coalesce(truth, X.parse_number(text), hashed)


def open_features(req: DataFrame, context: str = "context", keep: Sequence[str] = ("event_id",)) -> DataFrame:
    """X-12 + X-18 where the context's keys aren't known beforehand: ``features``,
    a map of float32 per request. It holds ``context_<key>`` for every key but the
    named ones, and the default features; a key with the name of a default
    feature overrides it instead. Nothing is collected, so keys may be many."""
    value = F.map_filter(context_values(F.col(context)), lambda k, _: ~k.isin(*NAMED_CONTEXT))
    found = F.transform_values(value, lambda _, v: context_number(v).cast("float"))
    found = F.transform_keys(found, lambda k, _: F.when(k.isin(*DEFAULT_FEATURES), k).otherwise(F.concat(F.lit("context_"), k)))
    defaults = F.create_map(*[x for k, v in DEFAULT_FEATURES.items() for x in (F.lit(k), F.lit(v).cast("float"))])
    # the found map is bound once: a lambda that named it would work it out anew for every default
    whole = F.transform(F.array(found), lambda m: F.map_concat(F.map_filter(defaults, lambda k, _: ~F.map_contains_key(m, k)), m))
    return req.select(*keep, whole[0].alias("features"))


def context_keys(req: DataFrame, context: str = "context") -> DataFrame:
    """Which keys the contexts hold: one row a key, the requests that bring it and
    those whose value is a number. Aggregated before it is shuffled."""
    each = req.select(F.explode(context_values(F.col(context))).alias("key", "value"))
    number = X.parse_number(F.col("value").try_cast("string")).isNotNull()
    return each.groupBy("key").agg(F.count(F.lit(1)).alias("requests"), F.count_if(number).alias("numeric"))


def known_features(features: DataFrame, names: Sequence[str], keep: Sequence[str] = ("event_id",)) -> DataFrame:
    """B12 for :func:`open_features`: a column per feature that a model knows, absent ones 0."""
    return features.select(*keep, *[F.coalesce(F.col("features")[n], F.lit(0.0)).cast("float").alias(n) for n in names])


def ctr_tier(p: Column) -> Column:
    """X-14."""
    e = F.lit(TOP_TIER)
    for bound, name in reversed(CTR_TIERS):
        e = F.when(p < bound, F.lit(name)).otherwise(e)
    return e


def response_columns(p: Column, raw: Column, bid: Column | None = None) -> list[Column]:
    """X-13..X-16: decision fields of one scored request."""
    b = F.coalesce(bid, F.lit(1.0)) if bid is not None else F.lit(1.0)
    return [
        p.alias("ctr_prediction"), raw.alias("raw_prediction"),
        (p >= 0.5).cast("int").alias("predicted_click"),
        (F.abs(p - 0.5) * 2).alias("confidence"),
        ctr_tier(p).alias("ctr_category"),
        F.when(p > BASELINE_CTR, "show").otherwise("skip").alias("recommendation"),
        (p * b).alias("expected_revenue"),
        (F.abs(p - raw) > 1e-6).alias("postprocessing_applied"),
    ]


def response_struct(df: DataFrame, version: str = "1") -> Column:
    """X-19: the nested response record (serialise with ``to_json``). What ``df``
    has no column for (user, ad, latency) is NULL."""
    own = lambda c, kind: (F.col(c) if c in df.columns else F.lit(None).cast(kind)).alias(c)
    supported = F.struct(*[F.lit(True).alias(c) for c in ("calibration", "ensemble", "postprocessing")])
    return F.struct(
        own("user_id", "string"), own("ad_id", "string"),
        F.col("ctr_prediction"), F.col("predicted_click"), F.col("confidence"), F.col("ctr_category"),
        F.col("recommendation"), F.col("expected_revenue"),
        F.struct(F.col("model_used"), F.col("postprocessing_applied")).alias("processing_pipeline"),
        F.struct(F.col("model_used").alias("model_name"), F.lit(version).alias("version"),
                 supported.alias("features_supported")).alias("model_info"),
        F.struct(own("latency_ms", "double"), F.col("ts").alias("timestamp")).alias("performance"))


def fit_ad_prior(req: DataFrame, y: str = "clicked", key: str = "ad_id", smoothing: float = 100.0) -> DataFrame:
    """Scoring model used by the request jobs: smoothed click rate per ad
    (F1 applied to ``ad_id``). One row per ad, so it is broadcast when small
    and left to AQE otherwise."""
    g = req.agg(F.avg(F.col(y).cast("double")).alias("__g"))
    s = req.groupBy(key).agg(F.count(F.col(y)).alias("__n"), F.avg(F.col(y).cast("double")).alias("__m"))
    return s.crossJoin(F.broadcast(g)).select(
        key, F.coalesce((F.col("__n") * F.col("__m") + smoothing * F.col("__g")) / (F.col("__n") + smoothing),
                        F.col("__g")).alias("p_raw"), F.col("__g").alias("prior_mean"))


def time_cut(req: DataFrame, pct: int = 60) -> Column:
    """Whether a request belongs to the last ``100 - pct`` percent of the time span:
    models are fitted on what came before and score what comes after."""
    micros = F.unix_micros(X.ntz_as_utc(F.col("ts")))
    span = req.agg(F.min(micros).alias("lo"), F.max(micros).alias("hi")).first()
    lo, hi = span["lo"] or 0, span["hi"] or 0
    return micros >= lo + (hi - lo) * pct // 100


def alignment_factor(prior: DataFrame, req: DataFrame, key: str = "ad_id",
                     target: float = BASELINE_CTR) -> DataFrame:
    """P3 factor computed once over a reference table (never from the row
    being scored): one row ``factor`` = target/mean when off by > 0.001."""
    m = join_small(req.select(key), prior.select(key, "p_raw"), [key], "left") \
        .agg(F.avg(F.greatest(F.least("p_raw", F.lit(0.9999)), F.lit(0.0001))).alias("__m"))
    return m.select(F.when((F.abs(F.col("__m") - target) > 0.001) & (F.col("__m") > 0), target / F.col("__m"))
                    .otherwise(F.lit(1.0)).alias("factor"))


def score_requests(req: DataFrame, prior: DataFrame, factor: DataFrame, key: str = "ad_id",
                   model_name: str = "ad_prior", keep: Sequence[str] = ("event_id", "ts", "clicked")) -> DataFrame:
    """Score, align with the precomputed factor, clip to [1e-4, 0.9999],
    decision fields. Unknown ads fall back to the baseline 0.0201 (failed
    prediction) with ``success = false``."""
    d = join_small(req, prior.select(key, "p_raw"), [key], "left").crossJoin(F.broadcast(factor))
    raw = F.greatest(F.least(F.col("p_raw"), F.lit(0.9999)), F.lit(0.0001))
    p = F.greatest(F.least(raw * F.col("factor"), F.lit(0.9999)), F.lit(0.0001))
    ok = F.col("p_raw").isNotNull()
    p = F.when(ok, p).otherwise(F.lit(BASELINE_CTR))
    raw = F.when(ok, raw).otherwise(F.lit(BASELINE_CTR))
    return d.select(*keep, F.lit(model_name).alias("model_used"), ok.alias("success"),
                    *response_columns(p, raw, F.col("bid_amount")))


def process_batches(scored: DataFrame, size: int = BATCH_REQUESTS, order: str = "event_id", target: float = BASELINE_CTR) -> DataFrame:
    """Post-processing (P1, P3, clip) of scored requests per ``size`` of them in
    request order, as the batch scorer does. Adds ``batch_no`` and renews the
    decision fields; failed requests stay at the baseline and move no mean.

    Positions come from one range shuffle, bounds from a sketch per batch."""
    from clickforge.operators.calibrate import post_process

    keep = [c for c in scored.columns if c not in ("ctr_prediction", "predicted_click", "confidence", "ctr_category", "recommendation",
                                                   "postprocessing_applied")]
    d = scored.withColumn("__bid", F.when(F.col("ctr_prediction") > 0, F.col("expected_revenue") / F.col("ctr_prediction")))
    rows, carry = laid_out(d, [], [F.col(order).asc()], keep=[*keep, "__bid"])
    rows = join_small(rows, carry, ["__part"], bounded=True)  # a row a part
    rows = rows.withColumn("batch_no", F.floor((F.col("__n_before") + F.col("__i") - F.col("__first")) / size).cast("long"))
    rows = rows.drop("__part", "__i", "__first", "__n", "__n_before")
    done = post_process(rows.where("success").withColumn("__p", F.col("raw_prediction")), "__p", target, ["batch_no"], diversity=False, key=order)
    done = done.unionByName(rows.where("not success").withColumn("__p", F.lit(BASELINE_CTR)))
    return done.select(*[c for c in keep if c not in ("raw_prediction", "expected_revenue")], "batch_no",
                       *response_columns(F.col("__p"), F.col("raw_prediction"), F.col("__bid")))


def failed_batch(req: DataFrame, error: str, keep: Sequence[str] = ("event_id", "ts", "clicked")) -> DataFrame:
    """What a batch that can't be scored gives: the baseline for every request, and the error's text."""
    base = F.lit(BASELINE_CTR)
    out = req.select(*keep, F.lit("error").alias("model_used"), F.lit(False).alias("success"), F.lit(-1).cast("long").alias("batch_no"),
                     *response_columns(base, base, F.col("bid_amount")))
    return out.withColumn("confidence", F.lit(0.0)).withColumn("ctr_category", F.lit("low")).withColumn("error", F.lit(error))


def serving_stats(resp: DataFrame, keys: Sequence[str] = ("model_used",), recent: int = 1000,
                  order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """G27 + W7: success/failure rates, post-processing share and mean change,
    and prediction statistics over the most recent ``recent`` responses per
    group (top-k by time: each task keeps k rows, then one small merge)."""
    keys = list(keys)
    base = resp.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.count(F.when(F.col("success"), 1)).alias("successful_predictions"),
        F.count(F.when(~F.col("success"), 1)).alias("failed_predictions"),
        F.avg(F.col("postprocessing_applied").cast("double")).alias("postprocessing_rate"),
        F.avg(F.col("ctr_prediction") - F.col("raw_prediction")).alias("avg_adjustment"),
        F.stddev_pop(F.col("ctr_prediction") - F.col("raw_prediction")).alias("adjustment_std"),
        F.count(F.when(F.col("ctr_prediction") > F.col("raw_prediction"), 1)).alias("positive_adjustments"))
    base = base.withColumn("success_rate", F.col("successful_predictions") / F.col("total_requests")) \
        .withColumn("failure_rate", F.col("failed_predictions") / F.col("total_requests"))
    last = recent_rows(resp.where(F.col("success")), keys, recent, order)
    rs = last.groupBy(*keys).agg(F.avg("ctr_prediction").alias("ctr_mean"),
                                 F.stddev_pop("ctr_prediction").alias("ctr_std"),
                                 F.min("ctr_prediction").alias("ctr_min"),
                                 F.max("ctr_prediction").alias("ctr_max"))
    return join_small(base, rs, keys, "left")


def recent_rows(df: DataFrame, keys: Sequence[str], n: int, order: Sequence[str]) -> DataFrame:
    """The ``n`` most recent rows per group (the limit is the feature).

    Without keys Spark plans ``orderBy.limit`` as TakeOrderedAndProject: each
    task keeps its own top n. With keys, ``row_number() <= n`` lets the
    optimizer insert a partial WindowGroupLimit before the shuffle (n up to
    ``spark.sql.optimizer.windowGroupLimitThreshold``), so a hot group ships
    at most n rows per map task instead of all of its rows."""
    from pyspark.sql import Window
    keys = list(keys)
    ordc = [F.col(c).desc() for c in order]
    if not keys:
        return df.orderBy(*ordc).limit(n)
    w = Window.partitionBy(*keys).orderBy(*ordc)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def api_usage(resp: DataFrame, flags: Sequence[str] = ()) -> DataFrame:
    """Calls, errors, success rate ``1 - errors/max(1, calls)`` and the
    usage rate of each pipeline flag column in ``flags``."""
    return _usage_rates(resp.agg(*_usage_counts(flags)), flags)


def _usage_counts(flags: Sequence[str]) -> list[Column]:
    return [F.count(F.lit(1)).alias("total_api_calls"), F.count(F.when(~F.col("success"), 1)).alias("api_error_count"),
            *[F.count(F.when(F.col(f), 1)).alias(f"{f}_count") for f in flags]]


def _usage_rates(a: DataFrame, flags: Sequence[str]) -> DataFrame:
    out = a.withColumn("api_success_rate",
                       1.0 - F.col("api_error_count") / F.greatest(F.col("total_api_calls"), F.lit(1)))
    for f in flags:
        out = out.withColumn(f"{f}_rate", F.col(f"{f}_count") / F.greatest(F.col("total_api_calls"), F.lit(1)))
    return out


#: Options of a call; a request without one of them has it switched on.
OPTIONS = ("use_calibration", "use_ensemble", "use_postprocessing")
PIPELINE_FLAGS = ("full_pipeline", "calibration", "ensemble", "postprocessing")


def pipeline_flags(df: DataFrame) -> DataFrame:
    """Whether a call asked for the full pipeline or, if not, for which parts of it."""
    asked = {o: F.coalesce(F.col(o), F.lit(True)) if o in df.columns else F.lit(True) for o in OPTIONS}
    full = asked[OPTIONS[0]] & asked[OPTIONS[1]] & asked[OPTIONS[2]]
    return df.select("*", full.alias("full_pipeline"), *[(~full & asked[o]).alias(o.removeprefix("use_")) for o in OPTIONS])


def observed_usage(resp: DataFrame, flags: Sequence[str]) -> tuple[DataFrame, Observation]:
    """G28 without a scan of its own: the counters of :func:`api_usage` are taken
    while ``resp`` is scored and written. Use the returned table in ONE action;
    then :func:`usage_report` gives the record."""
    seen = Observation()
    return resp.observe(seen, *_usage_counts(flags)), seen


def usage_report(resp: DataFrame, seen: Observation, flags: Sequence[str]) -> DataFrame:
    """The one row of counters and rates that :func:`observed_usage` took."""
    counts = seen.get
    names = ["total_api_calls", "api_error_count", *[f"{f}_count" for f in flags]]
    one = resp.sparkSession.range(1).select(*[F.lit(int(counts[n])).cast("long").alias(n) for n in names])
    return _usage_rates(one, flags)
