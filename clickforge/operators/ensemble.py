"""Ensembles over a wide prediction table.

Weights are fitted as a small per-model table from grouped metrics (one
ranking pass over the long form), then pivoted into a single row and
cross-joined (broadcast) onto the wide table: combining is a row expression.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickforge.operators import metrics as M
from clickforge.operators.ranking import join_small

# Fixed values from the reference ensembles.
PERF_FLOOR = 0.1
STACK_BIAS_FACTOR, STACK_BIAS_CAP = 10.0, 0.5
CORR_BIAS_FACTOR, CORR_BIAS_CAP, CORR_FLOOR = 15.0, 0.6, 0.05
STRATEGIES = ["simple_average", "performance_weighted", "ctr_corrected"]
TARGET_COMBINED = 0.35
FAILED_PREDICTION = 0.0191


def to_long(wide: DataFrame, models: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """Wide ``p_<model>`` columns -> ``(ids..., model, p)`` (Expand, no shuffle)."""
    return wide.unpivot(list(ids), list(models), "model", "p")


def simple_average(models: Sequence[str]) -> Column:
    """Row mean over the model columns."""
    return sum((F.col(m) for m in models), F.lit(0.0)) / len(models)


def weighted_average(models: Sequence[str], weight_prefix: str = "w_") -> Column:
    """sum(w*p)/sum(w) over models with a weight column; none -> E1."""
    num = sum((F.coalesce(F.col(f"{weight_prefix}{m}"), F.lit(0.0)) * F.col(m) for m in models), F.lit(0.0))
    den = sum((F.coalesce(F.col(f"{weight_prefix}{m}"), F.lit(0.0)) for m in models), F.lit(0.0))
    return F.when(den > 0, num / den).otherwise(simple_average(models))


def model_scores(long: DataFrame, y: str = "clicked", keys: Sequence[str] = ()) -> DataFrame:
    """AUC, AP and |CTR bias| per model (E3-E5 inputs)."""
    keys = ["model", *keys]
    sc = M.score_counts(long, keys, y, "p")          # one pass, checkpointed
    r = M.ranking_from_counts(sc, keys, bounded=True)
    b = M.base_from_counts(sc, keys).select(
        *keys, F.abs(F.col("predicted_ctr") - F.col("actual_ctr")).alias("bias"))
    # every model keeps its row: one without any finite score has no AUC and gets the floor
    return join_small(b, r, keys, "left", bounded=True)


def weight_table(scores: DataFrame) -> DataFrame:
    """Per model, normalised weights of three kinds.

    performance: ``max(0.5*AUC + 0.5*AP, 0.1)``; stacking (bias-penalised):
    ``max(s*(1-min(10*bias, 0.5)), 0.1)``; ctr_corrected:
    ``max(s*(1-min(15*bias, 0.6)), 0.05)``. A model whose AUC is undefined
    gets the floor. Normalisation is a window over the model table
    (one row per model)."""
    s = 0.5 * F.col("auc") + 0.5 * F.col("ap")
    perf = F.coalesce(F.greatest(s, F.lit(PERF_FLOOR)), F.lit(PERF_FLOOR))
    stack = F.coalesce(F.greatest(s * (1 - F.least(F.col("bias") * STACK_BIAS_FACTOR, F.lit(STACK_BIAS_CAP))),
                                  F.lit(PERF_FLOOR)), F.lit(PERF_FLOOR))
    corr = F.coalesce(F.greatest(s * (1 - F.least(F.col("bias") * CORR_BIAS_FACTOR, F.lit(CORR_BIAS_CAP))),
                                 F.lit(CORR_FLOOR)), F.lit(CORR_FLOOR))
    w = Window.partitionBy(F.lit(1))
    t = scores.select("model", perf.alias("perf"), stack.alias("stack"), corr.alias("corr"))
    return t.select("model", *[(F.col(c) / F.sum(c).over(w)).alias(f"{c}_weight")
                               for c in ("perf", "stack", "corr")])


def pivot_weights(weights: DataFrame, models: Sequence[str], kind: str) -> DataFrame:
    """One-row table ``w_<model>`` for a weight kind (bounded: one row)."""
    return weights.agg(*[F.max(F.when(F.col("model") == m, F.col(f"{kind}_weight"))).alias(f"w_{m}")
                         for m in models])


def strategy_predictions(wide: DataFrame, models: Sequence[str], weights: DataFrame) -> DataFrame:
    """E6 candidates as columns: simple_average, performance_weighted, ctr_corrected."""
    perf = pivot_weights(weights, models, "perf")
    corr = pivot_weights(weights, models, "corr")
    corr = corr.select(*[F.col(f"w_{m}").alias(f"c_{m}") for m in models])
    d = wide.crossJoin(F.broadcast(perf)).crossJoin(F.broadcast(corr))
    return d.select(*wide.columns,
                    simple_average(models).alias("simple_average"),
                    weighted_average(models, "w_").alias("performance_weighted"),
                    weighted_average(models, "c_").alias("ctr_corrected"))


def select_best(table: DataFrame, score: str, order: Sequence[str], name_col: str) -> DataFrame:
    """Argmax with a declared candidate order; strict ``>`` from -1 means
    the first of equal scores wins and a score of 0 can still win."""
    pos = F.array_position(F.array(*[F.lit(o) for o in order]), F.col(name_col))
    w = Window.partitionBy(F.lit(1)).orderBy(F.col(score).desc_nulls_last(), pos)
    return table.withColumn("selected", (F.row_number().over(w) == 1) & (F.col(score) > -1))


def strategy_selection(wide: DataFrame, models: Sequence[str], y: str = "clicked",
                       ids: Sequence[str] = ("row_key",)) -> DataFrame:
    """E6 + E9: combined score (G19) and CTR score (G20) per strategy, the
    chosen strategy, and whether it reaches the 0.35 target."""
    long = to_long(wide, models, [*ids, y])
    weights = weight_table(model_scores(long, y))
    sp = strategy_predictions(wide, models, weights)
    sl = sp.unpivot([*ids, y], STRATEGIES, "strategy", "p")
    mr = M.metric_row(sl, ["strategy"], y, "p", bounded=True)
    out = select_best(mr.select("strategy", "combined_score", "ctr_score", "ap", "weighted_log_loss"),
                      "combined_score", STRATEGIES, "strategy")
    return out.withColumn("target_reached", F.col("combined_score") >= TARGET_COMBINED)


def two_level(p_stack: Column, s_stack: Column, p_dyn: Column, s_dyn: Column) -> Column:
    """Combine two sub-ensembles weighted by their combined-score share;
    equal weights when both scores are 0."""
    tot = s_stack + s_dyn
    return F.when(tot > 0, (s_stack * p_stack + s_dyn * p_dyn) / tot).otherwise(0.5 * p_stack + 0.5 * p_dyn)


def with_fallback(ensemble: Column, first_model: Column, default: float = FAILED_PREDICTION) -> tuple[Column, Column]:
    """Best ensemble -> first model -> constant, with the source label."""
    p = F.coalesce(ensemble, first_model, F.lit(default))
    src = (F.when(ensemble.isNotNull(), "ensemble").when(first_model.isNotNull(), "single_model")
           .otherwise("default"))
    return p, src
