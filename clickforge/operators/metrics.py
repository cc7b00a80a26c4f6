"""Ranking and loss metrics as grouped aggregates.

Inputs are *long* tables: one row per (group..., label, score). Every metric
is computed per group in a bounded number of passes:

* one hash aggregate (partial + final, map-side combined) for counts, the
  confusion matrix at 0.5, log losses, CTR bias and prediction statistics;
* one ranking pass for AUC and step-wise AP over *distinct* scores, whose
  running sums come from ``value_prefix_sums`` (no unpartitioned window).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickforge.session import materialize as materialize_table

from clickforge.operators.ranking import join_small, laid_out, tie_blocks, value_prefix_sums

# Fixed values from the reference metrics.
EPS = 1e-15                 # probability clip for losses and AP
POS_WEIGHT = 49.8           # weighted log loss, positive class
NEG_WEIGHT = 1.0            # weighted log loss, negative class
WLL_CAP = 10.0              # combined score caps the weighted log loss here
AP_WEIGHT = 0.5
WLL_WEIGHT = 0.5
THRESHOLD = 0.5             # predicted click when p >= 0.5
LOGLOSS_DEFAULT = 100.0     # value reported when the core metrics cannot be computed
# ctr_score steps: bias below each bound -> score
CTR_SCORE_STEPS = [(0.0001, 1.0), (0.0005, 0.9), (0.001, 0.7), (0.002, 0.5)]


def clip(c: Column, lo: float = EPS, hi: float = 1 - EPS) -> Column:
    """``greatest(least(p, hi), lo)``."""
    return F.greatest(F.least(c, F.lit(hi)), F.lit(lo))


def repair(c: Column, lo: float = EPS, hi: float = 1 - EPS) -> Column:
    """Clip, then NaN/NULL -> 0.5 (infinities land on the bounds)."""
    return F.when(c.isNull() | F.isnan(c), F.lit(0.5)).otherwise(clip(c, lo, hi))


def ctr_score_expr(bias: Column) -> Column:
    """Step score of the absolute CTR bias."""
    e = F.greatest(F.lit(0.0), 1.0 - bias * 100)
    for bound, score in reversed(CTR_SCORE_STEPS):
        e = F.when(bias < bound, F.lit(score)).otherwise(e)
    return e


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def score_counts(df: DataFrame, keys: Sequence[str], y: str = "clicked", p: str = "p",
                 materialize: bool = True) -> DataFrame:
    """One row per (group, distinct score): rows ``__n`` and clicks ``__pos``.

    This is the only pass over the prediction table: partial aggregation runs
    map-side, so the shuffle carries at most one row per distinct score per
    task and a score shared by a third of all rows is one row after it. Every
    metric below is a function of these counts. The result is written to the
    shared checkpoint folder so its consumers (loss sums, ranking, bucket
    bounds) read it instead of rescanning the source.
    """
    keys = list(keys)
    c = df.where(F.col(y).isNotNull()).groupBy(*keys, F.col(p).cast("double").alias("__s")).agg(
        F.count(F.lit(1)).alias("__n"), F.sum(F.col(y).cast("long")).alias("__pos"))
    return materialize_table(c) if materialize else c


def ranking_from_counts(sc: DataFrame, keys: Sequence[str], buckets: int | None = None,
                        bounded: bool = False, single_class_auc: float | None = None) -> DataFrame:
    """G12 + G13 per group from ``score_counts``: exact ROC-AUC (ties get half
    credit) and step-wise average precision over distinct clipped scores.
    A single-class group has AUC NULL (evaluation) or ``single_class_auc``
    (0.5 in the trainer's variant).

    Exclusive running counts in descending score order come from
    ``value_prefix_sums`` (quantile buckets, no unpartitioned window).
    """
    keys = list(keys)
    lo, hi = EPS, 1 - EPS
    d = sc.where(_finite(F.col("__s")))
    d = value_prefix_sums(d, keys, "__s", ["__n", "__pos"], descending=True,
                          buckets=buckets, bounded=bounded)
    neg = F.col("__n") - F.col("__pos")
    neg_before = F.col("__n_before") - F.col("__pos_before")
    # AP thresholds are clipped scores: all raw scores >= hi share one threshold
    # (the top zone) and all raw scores <= lo share the last one (everything).
    per = d.select(
        *keys, "__s", "__n", "__pos",
        (F.col("__pos_before") + F.col("__pos")).alias("__tp_incl"),
        (F.col("__n_before") + F.col("__n")).alias("__n_incl"),
        neg_before.alias("__neg_before"), neg.alias("__neg"),
    )
    agg = per.groupBy(*keys).agg(
        F.sum("__n").alias("__rows"), F.sum("__pos").alias("__npos"),
        F.sum(F.col("__pos") * F.col("__neg_before")).alias("__auc_wrong"),
        F.sum(F.col("__pos") * F.col("__neg")).alias("__auc_ties"),
        F.sum(F.when((F.col("__s") > lo) & (F.col("__s") < hi),
                     F.col("__pos") * F.col("__tp_incl") / F.col("__n_incl"))).alias("__ap_mid"),
        F.sum(F.when(F.col("__s") >= hi, F.col("__pos"))).alias("__top_pos"),
        F.sum(F.when(F.col("__s") >= hi, F.col("__n"))).alias("__top_n"),
        F.sum(F.when(F.col("__s") <= lo, F.col("__pos"))).alias("__bot_pos"),
    )
    P, N = F.col("__npos"), F.col("__rows")
    NEG = N - P
    # rank-sum AUC: positives ranked above negatives + half of tied pairs
    auc = (P * NEG - F.col("__auc_wrong") - 0.5 * F.col("__auc_ties")) / (P * NEG)
    ap_sum = (F.coalesce(F.col("__ap_mid"), F.lit(0.0))
              + F.coalesce(F.col("__top_pos") * F.col("__top_pos") / F.col("__top_n"), F.lit(0.0))
              + F.coalesce(F.col("__bot_pos") * P / N, F.lit(0.0)))
    two = (P > 0) & (NEG > 0)
    return agg.select(*keys,
                      F.when(two, auc).otherwise(
                          F.lit(single_class_auc).cast("double") if single_class_auc is not None
                          else F.lit(None).cast("double")).alias("auc"),
                      F.when(two, ap_sum / P).otherwise(F.lit(0.0)).alias("ap"))


def ranking_from_rows(df: DataFrame, keys: Sequence[str], y: str = "clicked", p: str = "p",
                      buckets: int | None = None, bounded: bool = False, single_class_auc: float | None = None) -> DataFrame:
    """G12 + G13 per group straight from the predictions: one range shuffle of
    (keys, score, label), no table of distinct scores (see ``tie_blocks``).
    Same results as :func:`ranking_from_counts`."""
    keys = list(keys)
    lo, hi = EPS, 1 - EPS
    d = df.where(F.col(y).isNotNull()).select(*keys, F.col(p).cast("double").alias("__s"), F.col(y).alias("__y")).where(_finite(F.col("__s")))
    blocks, totals = tie_blocks(d, keys, "__s", "__y", hi, lo, buckets)
    n, pos = F.col("__n"), F.col("__pos")
    sums = blocks.groupBy(*keys).agg(
        F.sum(pos * (F.col("__n_before") - F.col("__pos_before"))).alias("__auc_wrong"),
        F.sum(pos * (n - pos)).alias("__auc_ties"),
        F.sum(F.when((F.col("__s") > lo) & (F.col("__s") < hi),
                     pos * (F.col("__pos_before") + pos) / (F.col("__n_before") + n))).alias("__ap_mid"))
    a = join_small(totals, sums, keys, "left", bounded=bounded)
    P, N = F.col("__pos"), F.col("__n")
    pairs = P * (N - P)
    auc = (pairs - F.coalesce("__auc_wrong", F.lit(0)) - 0.5 * F.coalesce("__auc_ties", F.lit(0))) / pairs
    # AP thresholds are clipped scores: those from hi on share one, those up to lo the last
    ap = (F.coalesce("__ap_mid", F.lit(0.0)) + F.coalesce(F.col("__top_pos") * F.col("__top_pos") / F.nullif("__top_n", F.lit(0)), F.lit(0.0))
          + F.col("__low_pos") * P / N) / P
    two = (P > 0) & (P < N)
    one = F.lit(single_class_auc).cast("double")
    return a.select(*keys, F.when(two, auc).otherwise(one).alias("auc"), F.when(two, ap).otherwise(F.lit(0.0)).alias("ap"))


def ranking_metrics(df: DataFrame, keys: Sequence[str], y: str = "clicked", p: str = "p",
                    buckets: int | None = None, bounded: bool = False) -> DataFrame:
    """G12 + G13 per group over a prediction table."""
    return ranking_from_rows(df, keys, y, p, buckets, bounded)


def repaired_scores(df: DataFrame, keys: Sequence[str], y: str, p: str, bounded: bool = False) -> DataFrame:
    """B16 on predictions: a group that holds any NULL, NaN or infinite score has
    all its scores clipped, NaN and NULL become 0.5; others stay as they are."""
    keys = list(keys)
    d = df.where(F.col(y).isNotNull()).select(*keys, y, F.col(p).cast("double").alias(p))
    bad = materialize_table(d.groupBy(*keys).agg(F.max((~_finite(F.col(p))).cast("int")).alias("__any_bad")))  # a row a group
    return join_small(d, bad, keys, "left", bounded=bounded).withColumn(
        p, F.when(F.col("__any_bad") == 1, repair(F.col(p))).otherwise(F.col(p))).drop("__any_bad")


def base_from_counts(sc: DataFrame, keys: Sequence[str]) -> DataFrame:
    """G10, G15-G17, G21 per group from ``score_counts`` (count-weighted sums
    over distinct scores, one partial aggregate)."""
    keys = list(keys)
    n, pos, p = F.col("__n"), F.col("__pos"), F.col("__s")
    neg = n - pos
    pc = clip(p)
    lp, ln = -F.log(pc), -F.log(1 - pc)          # loss of a click / of a non-click
    pred1 = p >= THRESHOLD
    has_p = p.isNotNull()
    tot = lambda e, cond: F.sum(F.when(cond, e).otherwise(0))
    return sc.groupBy(*keys).agg(
        F.sum(n).alias("n"),
        F.sum(pos).alias("n_pos"),
        tot(n, ~_finite(p)).alias("__bad"),
        tot(pos, pred1).alias("tp"), tot(neg, pred1).alias("fp"),
        tot(neg, ~pred1).alias("tn"), tot(pos, ~pred1).alias("fn"),
        (F.sum(pos * lp + neg * ln) / F.sum(n)).alias("__ll"),
        (F.sum(POS_WEIGHT * pos * lp + NEG_WEIGHT * neg * ln)
         / F.sum(POS_WEIGHT * pos + NEG_WEIGHT * neg)).alias("__wll"),
        (F.sum(F.when(neg > 0, neg * ln)) / F.sum(F.when(neg > 0, neg))).alias("__ll_neg"),
        (F.sum(F.when(pos > 0, pos * lp)) / F.sum(F.when(pos > 0, pos))).alias("__ll_pos"),
        (F.sum(pos) / F.sum(n)).alias("actual_ctr"),
        (F.sum(F.when(has_p, n * p)) / F.sum(F.when(has_p, n))).alias("predicted_ctr"),
    )


def metric_row(df: DataFrame, keys: Sequence[str] = ("model",), y: str = "clicked",
               p: str = "p", buckets: int | None = None, bounded: bool = False,
               digits: int | None = 6, repaired: bool = False) -> DataFrame:
    """G22 (with G10-G21 inside): one metric record per group. ``repaired``
    applies B16 first, as the model comparison does.

    Single-class groups, and groups holding a non-finite score, fall to the
    reference defaults for the core block (AUC null, AP 0, log loss 100,
    combined score and threshold metrics 0); the CTR block is always computed.
    """
    keys = list(keys)
    if repaired:
        df = repaired_scores(df, keys, y, p, bounded)
    rows = df.where(F.col(y).isNotNull()).select(*keys, F.col(p).cast("double").alias("__s"), F.lit(1).cast("long").alias("__n"),
                                                 F.col(y).cast("long").alias("__pos"))
    base = base_from_counts(rows, keys)  # one partial aggregate over the rows
    rank = ranking_from_rows(df, keys, y, p, buckets=buckets, bounded=bounded)
    j = join_small(base, rank, keys, "left", bounded=bounded)
    n, npos = F.col("n"), F.col("n_pos")
    ok = (npos > 0) & (npos < n) & (F.col("__bad") == 0)
    wll = F.col("__wll")
    combined = AP_WEIGHT * F.col("ap") + WLL_WEIGHT * (1.0 - F.least(wll, F.lit(WLL_CAP)) / WLL_CAP)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    f1 = F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0)
    spec = F.when(tn + fp > 0, tn / (tn + fp)).otherwise(0.0)
    bias = F.col("predicted_ctr") - F.col("actual_ctr")
    zero = F.lit(0.0)
    out = j.select(
        *keys, n.alias("n"), npos.alias("n_pos"),
        F.when(ok, F.col("auc")).alias("auc"),
        F.when(ok, F.col("ap")).otherwise(zero).alias("ap"),
        F.when(ok, F.col("__ll")).otherwise(F.lit(LOGLOSS_DEFAULT)).alias("log_loss"),
        F.when(ok, wll).otherwise(F.lit(LOGLOSS_DEFAULT)).alias("weighted_log_loss"),
        F.when(ok, combined).otherwise(zero).alias("combined_score"),
        F.when(ok, (tp + tn) / n).otherwise(zero).alias("accuracy"),
        F.when(ok, prec).otherwise(zero).alias("precision"),
        F.when(ok, rec).otherwise(zero).alias("recall"),
        F.when(ok, spec).otherwise(zero).alias("specificity"),
        F.when(ok, f1).otherwise(zero).alias("f1_score"),
        F.col("actual_ctr"), F.col("predicted_ctr"),
        bias.alias("ctr_bias"), F.abs(bias).alias("ctr_absolute_error"),
        F.when(F.col("actual_ctr") > 0, F.abs(bias) / F.col("actual_ctr"))
         .otherwise(F.lit(float("inf"))).alias("ctr_relative_error"),
        ctr_score_expr(F.abs(bias)).alias("ctr_score"),
    )
    return round_doubles(out, digits)


def loss_metrics(df: DataFrame | None, keys: Sequence[str] = ("model",), y: str = "clicked",
                 p: str = "p", digits: int | None = 6, with_ap: DataFrame | None = None,
                 counts: DataFrame | None = None, bounded: bool = True) -> DataFrame:
    """Log loss, class-balanced log loss, weighted log loss, and the
    competition score ``0.5*AP + 0.5/(1+balanced)`` when AP is supplied."""
    keys = list(keys)
    a = base_from_counts(counts if counts is not None else score_counts(df, keys, y, p), keys)
    bal = 0.5 * F.coalesce(F.col("__ll_neg"), F.lit(0.0)) + 0.5 * F.coalesce(F.col("__ll_pos"), F.lit(0.0))
    out = a.select(*keys, F.col("__ll").alias("log_loss"), bal.alias("balanced_log_loss"),
                   F.col("__wll").alias("weighted_log_loss"))
    if with_ap is not None:
        out = join_small(out, with_ap.select(*keys, "ap"), keys, "left", bounded=bounded)
        out = out.withColumn("competition_score",
                             0.5 * F.col("ap") + 0.5 / (1 + F.col("balanced_log_loss")))
        out = out.withColumn("combined_score",
                             AP_WEIGHT * F.col("ap") + WLL_WEIGHT *
                             (1 - F.least(F.col("weighted_log_loss"), F.lit(WLL_CAP)) / WLL_CAP))
    return round_doubles(out, digits)


def prediction_summary(df: DataFrame, keys: Sequence[str] = ("model",), p: str = "p",
                       digits: int | None = 6) -> DataFrame:
    """Mean, population std, min, max of predictions per group."""
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean"),
                                F.stddev_pop(p).alias("std"), F.min(p).alias("min"),
                                F.max(p).alias("max"))
    return round_doubles(out, digits)


def class_weights(df: DataFrame, y: str = "clicked", keys: Sequence[str] = ()) -> DataFrame:
    """Positive-class weight ``(1-p)/p`` and balanced weights ``n/(2 n_c)``."""
    keys = list(keys)
    a = df.where(F.col(y).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("long")).alias("n_pos"))
    rate = F.col("n_pos") / F.col("n")
    nneg = F.col("n") - F.col("n_pos")
    return a.select(*keys, "n", "n_pos", rate.alias("ctr"),
                    F.when(F.col("n_pos") > 0, (1 - rate) / rate).alias("pos_weight"),
                    F.when(F.col("n_pos") > 0, F.col("n") / (2 * F.col("n_pos"))).alias("balanced_pos"),
                    F.when(nneg > 0, F.col("n") / (2 * nneg)).alias("balanced_neg"))


def ap_rowwise(df: DataFrame, keys: Sequence[str] = ("model",), y: str = "clicked",
               p: str = "p", key: str = "row_key", buckets: int | None = None,
               bounded: bool = False, digits: int | None = 6) -> DataFrame:
    """Row-by-row AP (precision at every positive in score order), ties
    broken by ``key`` ascending.

    The rows are laid out once in the order (group, score, key), split anywhere,
    within ties too; each part's totals are carried into the next ones. Only the
    clicks are read again: their position is known, and their number among the
    clicks comes from a window over them alone, part by part.
    """
    keys = list(keys)
    s = F.when(_finite(F.col(p)), F.col(p)).otherwise(repair(F.col(p)))  # B16: such rows keep their place
    base = df.where(F.col(y).isNotNull()).select(*keys, s.alias("__s"), F.col(y).cast("long").alias("__y"),
                                                 F.col(key).cast("string").alias("__k"))
    rows, carry = laid_out(base, keys, [F.col("__s").desc(), F.col("__k").asc()], sums=["__y"], parts=buckets)
    clicks = rows.where("__y = 1").select(*keys, "__part", "__i")
    nth = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy("__i"))
    clicks = join_small(clicks.withColumn("__nth", nth), carry, [*keys, "__part"], "left", bounded=bounded)
    prec = (F.col("__y_before") + F.col("__nth")) / (F.col("__n_before") + F.col("__i") - F.col("__first") + 1)
    out = clicks.groupBy(*keys).agg((F.sum(prec) / F.count(F.lit(1))).alias("ap_rowwise"))
    groups = carry.select(*keys).distinct()
    out = join_small(groups, out, keys, "left") if keys else out
    return round_doubles(out.select(*keys, F.coalesce("ap_rowwise", F.lit(0.0)).alias("ap_rowwise")), digits)


def round_doubles(df: DataFrame, digits: int | None) -> DataFrame:
    """Round double columns so results compare across engines and sum orders."""
    if digits is None:
        return df
    cols = []
    for f in df.schema.fields:
        if f.dataType.typeName() == "double":
            cols.append(F.round(F.col(f.name), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
