"""CTR correction, exact quantiles and post-processing.

Each step of these chains needs a table-wide scalar (a mean, a percentile)
of the *previous* step's output. For the CTR correction the scores are reduced
ONCE to a checkpointed ``(group, value, count)`` table; every step maps values
deterministically, so all scalars of the chain are weighted aggregates over it.
Post-processing takes its bounds by selection inside sketched brackets and its
means from the rows. The rows are then touched by one projection with the final
scalars (broadcast when they are one row, or one row per group).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickforge.session import materialize as materialize_table

from clickforge.operators.ranking import join_small, row_index, value_prefix_sums

# Fixed values from the reference post-processing.
TRAIN_TARGET_CTR = 0.0191
SERVING_TARGET_CTR = 0.0201
CTR_GATE = 0.001
FINAL_GATE = 0.002
EPS = 1e-15
SERVING_LO = 0.0001
SERVING_HI = 0.9999
DIVERSITY_THRESHOLD = 1000
NOISE_FACTOR = 0.008

V, C = "__v", "__c"


def _clip(c: Column, lo, hi) -> Column:
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    hi = hi if isinstance(hi, Column) else F.lit(hi)
    return F.greatest(F.least(c, hi), lo)


def _with_scalar(df: DataFrame, agg: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach a per-group (or table-wide) scalar row."""
    keys = list(keys)
    if not keys:
        return df.crossJoin(F.broadcast(agg))
    return join_small(df, agg, keys, "left")


def value_counts(df: DataFrame, p: str, keys: Sequence[str] = (), materialize: bool = True) -> DataFrame:
    """``(keys, __v, __c)``: distinct scores with their row counts (NULL kept
    as its own value). Partial aggregation runs map-side; checkpointed."""
    vc = df.groupBy(*keys, F.col(p).cast("double").alias(V)).agg(F.count(F.lit(1)).alias(C))
    return materialize_table(vc) if materialize else vc


def _wmean(expr: Column) -> Column:
    """Row mean of ``expr`` over a value-count table (NULLs skipped, like avg)."""
    return F.sum(F.when(expr.isNotNull(), F.col(C) * expr)) / F.sum(F.when(expr.isNotNull(), F.col(C)))


def _correction_scalars(vc: DataFrame, keys: Sequence[str], target: float) -> DataFrame:
    keys = list(keys)
    p0 = _clip(F.col(V), EPS, 1 - EPS)
    m1 = vc.groupBy(*keys).agg(_wmean(p0).alias("__m1"))
    a = _with_scalar(vc, m1, keys)
    p1 = _p1(p0, target)
    m2 = a.groupBy(*keys).agg(F.first("__m1").alias("__m1"), _wmean(p1).alias("__m2"))
    b = _with_scalar(vc, m2, keys)
    p2 = _p2(_p1(p0, target), target)
    return b.groupBy(*keys).agg(F.first("__m1").alias("__m1"), F.first("__m2").alias("__m2"),
                                (F.abs(_wmean(p2) - target) < CTR_GATE).alias("ctr_ok"))


def _p1(p0: Column, target: float) -> Column:
    return F.when(F.col("__m1") > 0, _clip(p0 * (target / F.col("__m1")), EPS, 1 - EPS)).otherwise(F.lit(target))


def _p2(p1: Column, target: float) -> Column:
    return F.when(F.abs(F.col("__m2") - target) > CTR_GATE,
                  _clip(p1 * (target / F.col("__m2")), EPS, 1 - EPS)).otherwise(p1)


def ctr_correction(df: DataFrame, p: str = "p", target: float = TRAIN_TARGET_CTR,
                   keys: Sequence[str] = (), out: str = "p_corrected") -> DataFrame:
    """X-17: clip, scale to the target mean (constant target when the mean is
    0), clip; if the mean is still off by more than 0.001, scale once more.
    Adds ``out`` and the gate column ``ctr_ok`` (final mean within 0.001)."""
    keys = list(keys)
    sc = _correction_scalars(value_counts(df, p, keys), keys, target)
    d = _with_scalar(df, sc, keys)
    val = _p2(_p1(_clip(F.col(p), EPS, 1 - EPS), target), target)
    return d.withColumn(out, val).drop("__m1", "__m2")


#: Size of the quantile sketch, and how far (in ranks of one) a bracket reaches to both
#: sides: some four times the error that a sketch of this size makes once in a hundred.
SKETCH_K = 4096
BRACKET = 0.005


def exact_quantiles(df: DataFrame, value: str, qs: Sequence[float], keys: Sequence[str] = (),
                    buckets: int | None = None, prefix: str = "q", bracket: float = BRACKET) -> DataFrame:
    """Exact linear-interpolation quantiles (numpy ``linear``, DuckDB
    ``quantile_cont``) per group, by selection inside sketched brackets.

    One pass merges a KLL sketch per group, which brackets each quantile between
    two values; a second counts the rows below each bracket and collapses only
    the rows inside to ``(value, n)``, so a hundredth of the rows is shuffled
    and ordered. Positions are then looked up by running counts. A bracket that
    misses its position (the counts tell) is widened and the passes repeated,
    up to the whole range. Output: one row per group with columns ``q<idx>`` in
    the order of ``qs``; NULL and NaN are left out.
    """
    keys = list(keys)
    d = df.select(*keys, F.col(value).cast("double").alias(V)).where(F.col(V).isNotNull() & ~F.isnan(V))
    sketch = materialize_table(d.groupBy(*keys).agg(F.kll_sketch_agg_double(V, F.lit(SKETCH_K)).alias("__sketch"), F.count(F.lit(1)).alias("__total"),
                                                    F.min(V).alias("__min"), F.max(V).alias("__max")))  # a row a group
    at = lambda r: F.kll_sketch_get_quantile_double("__sketch", F.lit(float(r)))
    while True:
        ends = [f(i, q) for i, q in enumerate(qs) for f in (
            lambda i, q: (F.col("__min") if q - bracket <= 0 else at(q - bracket)).alias(f"__lo{i}"),
            lambda i, q: (F.col("__max") if q + bracket >= 1 else at(q + bracket)).alias(f"__hi{i}"))]
        ranges = materialize_table(sketch.select(*keys, "__total", *ends))
        inside = [(F.col(V) >= F.col(f"__lo{i}")) & (F.col(V) <= F.col(f"__hi{i}")) for i in range(len(qs))]
        some = inside[0]
        for x in inside[1:]:
            some = some | x
        # one row for each value inside a bracket, and one for all values outside
        found = materialize_table(_with_scalar(d, ranges, keys).groupBy(*keys, F.when(some, F.col(V)).alias("__in")).agg(
            F.count(F.lit(1)).alias("__n"), *[F.count_if(F.col(V) < F.col(f"__lo{i}")).alias(f"__below{i}") for i in range(len(qs))]))
        below = found.groupBy(*keys).agg(*[F.sum(f"__below{i}").alias(f"__below{i}") for i in range(len(qs))])
        scalars = join_small(ranges, below, keys)
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q"), F.col(f"__lo{i}").alias("lo"), F.col(f"__hi{i}").alias("hi"),
                                            F.col(f"__below{i}").alias("below")) for i, q in enumerate(qs)]))
        wanted = materialize_table(scalars.select(*keys, "__total", each.alias("x")).select(
            *keys, "__total", F.col("x.i").alias("__q"), (F.col("x.q") * (F.col("__total") - 1)).alias("__pos"), "x.lo", "x.hi", "x.below"))
        values = _with_scalar(found.where(F.col("__in").isNotNull()).select(*keys, F.col("__in").alias(V), "__n"),
                              wanted.groupBy(*keys).agg(F.collect_list(F.struct("__q", "lo", "hi")).alias("__x")), keys)
        values = values.withColumn("__x", F.explode("__x")).where((F.col(V) >= F.col("__x.lo")) & (F.col(V) <= F.col("__x.hi")))
        values = values.select(*keys, F.col("__x.__q").alias("__q"), V, "__n")
        running = value_prefix_sums(values, [*keys, "__q"], V, ["__n"], descending=False, buckets=buckets)
        placed = join_small(running, wanted.drop("lo", "hi"), [*keys, "__q"])
        start = F.col("below") + F.col("__n_before")
        cover = lambda t: (start <= t) & (t < start + F.col("__n"))
        picked = materialize_table(placed.groupBy(*keys, "__q").agg(
            F.max(F.when(cover(F.floor("__pos")), F.col(V))).alias("__low"), F.max(F.when(cover(F.ceil("__pos")), F.col(V))).alias("__high"),
            F.first(F.col("__pos") - F.floor("__pos")).alias("__part")))
        missed = join_small(wanted, picked, [*keys, "__q"]).where("__low is null or __high is null")
        if missed.isEmpty():
            break
        bracket *= 8
    value_at = F.col("__low") + (F.col("__high") - F.col("__low")) * F.col("__part")
    return picked.groupBy(*keys).agg(*[F.max(F.when(F.col("__q") == i, value_at)).alias(f"{prefix}{i}") for i in range(len(qs))])


def _outlier_bounds(df: DataFrame, p: str, keys: Sequence[str]) -> DataFrame:
    """P1 bounds ``[max(0.1*q01, 1e-4), min(1.1*q99, 0.9999)]`` per group."""
    q = exact_quantiles(df, p, [0.01, 0.99], keys)
    return q.select(*keys, F.greatest(F.col("q0") * 0.1, F.lit(SERVING_LO)).alias("__lo"),
                    F.least(F.col("q1") * 1.1, F.lit(SERVING_HI)).alias("__hi"))


def _spread(df: DataFrame, x: Column, keys: Sequence[str]) -> DataFrame:
    """Distinct values ``__nd`` and population std ``__sd`` of ``x`` per group. The
    number matters only below DIVERSITY_THRESHOLD: a sketch tells which groups
    may have so few values, and only theirs are collapsed and counted."""
    keys = list(keys)
    d = df.select(*keys, x.alias("__x"))
    stats = materialize_table(d.groupBy(*keys).agg(F.approx_count_distinct("__x", 0.01).alias("__about"), F.stddev_pop("__x").alias("__sd")))
    few = _with_scalar(d, stats.drop("__sd"), keys).where(F.col("__about") < 2 * DIVERSITY_THRESHOLD)
    exact = few.groupBy(*keys, "__x").agg(F.count(F.lit(1)).alias("__c")).groupBy(*keys).agg(F.count(F.lit(1)).alias("__exact"))
    if not keys:
        exact = exact.where("__exact > 0")
        return stats.join(F.broadcast(exact), F.lit(True), "left").select(F.coalesce("__exact", "__about").alias("__nd"), "__sd")
    return join_small(stats, exact, keys).select(*keys, F.coalesce("__exact", "__about").alias("__nd"), "__sd")


def content_noise(key: str, seed: int) -> Column:
    """Standard normal noise from ``md5(key || seed)`` (Box-Muller): the same for
    a row wherever and however often it is computed."""
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed))))
    unit = lambda at: F.conv(F.substring(h, at, 8), 16, 10).cast("double")
    radius = F.sqrt(-2 * F.log((unit(1) + 1) / F.lit(4294967296.0)))
    return radius * F.cos(unit(9) * F.lit(2 * math.pi / 4294967296.0))


def _aligned(x: Column, target: float) -> Column:
    """P3 for one value given the group mean ``__m`` of the inputs."""
    return F.when((F.abs(F.col("__m") - target) > CTR_GATE) & (F.col("__m") > 0),
                  _clip(x * (target / F.col("__m")), SERVING_LO, SERVING_HI)).otherwise(x)


def post_process(df: DataFrame, p: str = "p", target: float = SERVING_TARGET_CTR,
                 keys: Sequence[str] = (), outliers: bool = True, diversity: bool = True,
                 alignment: bool = True, seed: int = 42, key: str = "row_key") -> DataFrame:
    """P1 -> P2 -> P3 -> clip to [1e-4, 0.9999], each switchable.
    ``keys=['batch_id']`` reproduces the reference's per-batch processing.

    Scalars are aggregates over the rows, bounds come from sketched brackets: no
    table of all distinct scores. P2 adds row noise, so its output is written
    once and P3's mean is taken there.
    """
    keys = list(keys)
    d = df
    x = F.col(p).cast("double")
    if outliers:
        d = _with_scalar(d, materialize_table(_outlier_bounds(df, p, keys)), keys)  # a row a group
        x = _clip(x, F.col("__lo"), F.col("__hi"))
    if diversity:
        d = _with_scalar(d, _spread(d, x, keys), keys)
        noise = content_noise(key, seed) * F.greatest(F.col("__sd") * NOISE_FACTOR, F.lit(1e-6))
        x = F.when(F.col("__nd") < DIVERSITY_THRESHOLD, _clip(x + noise, SERVING_LO, SERVING_HI)).otherwise(x)
        d = d.withColumn(p, x).drop("__lo", "__hi", "__nd", "__sd").transform(materialize_table)
        x = F.col(p)
    if alignment:
        d = _with_scalar(d, d.groupBy(*keys).agg(F.avg(x).alias("__m")), keys)
        x = _aligned(x, target)
    return d.withColumn(p, _clip(x, SERVING_LO, SERVING_HI)).drop("__lo", "__hi", "__m")


def clip_outliers(df: DataFrame, p: str = "p", keys: Sequence[str] = ()) -> DataFrame:
    """P1 alone."""
    return post_process(df, p, keys=keys, outliers=True, diversity=False, alignment=False)


def diversity_noise(df: DataFrame, p: str = "p", keys: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """P2 alone: when a group has fewer than 1000 distinct scores, add
    Gaussian noise with sd ``max(0.008*std_pop, 1e-6)`` and clip.
    The noise is a function of the row's key and the seed."""
    return post_process(df, p, keys=keys, outliers=False, diversity=True, alignment=False, seed=seed)


def align_ctr(df: DataFrame, p: str = "p", target: float = SERVING_TARGET_CTR,
              keys: Sequence[str] = ()) -> DataFrame:
    """P3 alone."""
    return post_process(df, p, target, keys, outliers=False, diversity=False, alignment=True)


def table_scoring(df: DataFrame, p: str = "p", key: str = "row_key", batch_size: int | None = None,
                  target: float = SERVING_TARGET_CTR, diversity: bool = True, seed: int = 42) -> DataFrame:
    """P5: post-process scores (P4) globally or per ``batch_size`` rows in key
    order (the reference's batches), clip, then rescale globally when the mean
    is off the target by more than 0.002. Batch ids come from the bucketed
    ``row_index`` (no global sort) and are checkpointed with the scores."""
    keys: list[str] = []
    d = df
    if batch_size:
        d = row_index(d.select(key, p), [], F.col(key).cast("string"), name="__i") \
            .withColumn("batch_id", F.floor(F.col("__i") / batch_size).cast("long")).drop("__i") \
            .transform(materialize_table)
        keys = ["batch_id"]
    d = post_process(d, p, target, keys, diversity=diversity, seed=seed)
    if diversity:
        d = materialize_table(d)
        m = d.agg(F.avg(p).alias("__g"))
    else:
        # final mean from the value counts of the post-processed scores
        m = value_counts(d, p, keys).agg(_wmean(F.col(V)).alias("__g"))
    d = d.crossJoin(F.broadcast(m))
    scaled = _clip(F.col(p) * (target / F.col("__g")), SERVING_LO, SERVING_HI)
    return d.withColumn(p, F.when((F.abs(F.col("__g") - target) > FINAL_GATE) & (F.col("__g") > 0), scaled)
                        .otherwise(F.col(p))).drop("__g")
