"""Schema and label decisions from one aggregate pass.

Each decision needs a handful of statistics per column; all columns are
measured in ONE wide aggregate (partial aggregation on every task), and the
single result row is unpivoted into a per-column table. The decision itself
is a window over that table, whose size is the column count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values from the reference configuration (label detection).
TARGET_CANDIDATES = ["clicked", "click", "is_click", "target", "label", "y",
                     "ctr", "response", "conversion", "action"]
MIN_CTR = 0.001
MAX_CTR = 0.1
TYPICAL_CTR = (0.005, 0.05)
# Label confirmation inside feature preparation uses a shorter list.
CONFIRM_CANDIDATES = ["clicked", "click", "is_click", "target", "label", "y"]
# Categorical names and continuous name patterns; categorical needs < 10,000 values.
EXPECTED_CATEGORICAL = ["gender", "age_group", "inventory_id", "day_of_week", "hour"]
CONTINUOUS_PATTERNS = ["feat_a_", "feat_b_", "feat_c_", "feat_d_", "feat_e_",
                       "history_a_", "history_b_", "l_feat_"]
MAX_CATEGORY_VALUES = 10000
INT_FLOAT_TYPES = (T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


def distinct_counts(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """``(column_name, n_distinct)`` of the non-null values. The columns are
    unpivoted to ``(column_name, value)`` rows, deduplicated by partial
    aggregation and counted: one row per distinct value is shuffled, not one
    copy of the table per column. ``approximate`` uses mergeable sketches."""
    types = {f.name: f.dataType for f in df.schema.fields}

    def text(c: str):
        v = F.col(f"`{c}`")
        return (v + F.lit(0.0) if isinstance(types[c], T.FractionalType) else v).cast("string")  # -0.0 is 0.0

    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), text(c).alias("value")) for c in columns])
    long = df.select(F.explode(pairs).alias("e")).select("e.*")
    if approximate:
        return long.groupBy("column_name").agg(F.approx_count_distinct("value").alias("n_distinct"))
    return long.groupBy("column_name", "value").agg(F.lit(1)).groupBy("column_name") \
        .agg(F.count("value").alias("n_distinct"))


def column_stats(df: DataFrame, distinct_for: Sequence[str] = (), inf_for: Sequence[str] = (),
                 approximate: bool = False) -> DataFrame:
    """G4/G5 for every column: ordinal, numeric flag, binary flag (non-null
    values within {0,1}; an all-null column passes), the rate of binary
    columns (counts of ones over non-null values; NULL for any other column,
    as a rate is taken only after the binary test), non-null count, how many
    of the values 0 and 1 occur, and — only for ``distinct_for`` — the distinct
    count. One plain partial aggregate for the whole table."""
    from clickforge.functions.exprs import category_has_inf
    aggs, meta = [], []
    distinct_for, inf_for = set(distinct_for), set(inf_for)
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        num = isinstance(f.dataType, (T.NumericType, T.BooleanType))
        v = c.cast("double") if num else None
        binary = (F.coalesce(F.bool_and(v.isin(0.0, 1.0)), F.lit(True)) if num
                  else (F.count(c) == 0))
        rate = (F.when(binary, F.sum((v == 1.0).cast("long")) / F.nullif(F.count(c), F.lit(0)))
                if num else F.lit(None).cast("double"))
        zo = (F.max((v == 0.0).cast("int")) + F.max((v == 1.0).cast("int"))) if num else F.lit(0)
        inf = F.max(category_has_inf(c).cast("int")) == 1 if f.name in inf_for else F.lit(False)
        aggs += [binary.alias(f"b{i}"), rate.alias(f"r{i}"), F.count(c).alias(f"c{i}"),
                 F.coalesce(zo, F.lit(0)).alias(f"z{i}"),
                 F.coalesce(inf, F.lit(False)).alias(f"x{i}")]
        meta.append((i, f.name, num))
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(i).alias("ordinal"), F.lit(name).alias("column_name"),
                     F.lit(num).alias("is_numeric"), F.col(f"b{i}").alias("is_binary"),
                     F.col(f"r{i}").alias("rate"), F.col(f"c{i}").cast("long").alias("non_null"),
                     F.col(f"z{i}").cast("long").alias("n_binary_values"),
                     F.col(f"x{i}").alias("has_inf"))
            for i, name, num in meta]
    out = wide.select(F.explode(F.array(*rows)).alias("s")).select("s.*")
    columns = [f.name for f in df.schema.fields if f.name in distinct_for]
    if not columns:
        return out.withColumn("n_distinct", F.lit(None).cast("long"))
    # one row per column on both sides
    return out.join(F.broadcast(distinct_counts(df, columns, approximate)), "column_name", "left")


def _score(rate):
    lo, hi = TYPICAL_CTR
    dist = F.when(rate < lo, lo - rate).otherwise(rate - hi)
    s = F.when((rate >= lo) & (rate <= hi), F.lit(100.0)) \
        .otherwise(F.greatest(F.lit(0.0), 100.0 - dist * 1000))
    return F.coalesce(s, F.lit(0.0))


def label_candidates(df: DataFrame, candidates: Sequence[str] = TARGET_CANDIDATES,
                     head_rows: int | None = None) -> DataFrame:
    """Every column with its detection stage and the chosen label.

    Stage 1: exact candidate name, in candidate-list order, binary with
    ``MIN_CTR <= rate <= MAX_CTR``. Stage 2: first column (table order) whose
    lower-case name contains any candidate, same test. Stage 3: best
    typical-range score among binary columns, first column wins ties.
    ``head_rows`` reproduces the reference's decision on the first rows of the
    file (``limit``: the scan's first rows in split order, as scans are never
    rebalanced); the default uses the whole table.
    """
    st = column_stats(df.limit(head_rows) if head_rows else df)
    name = F.col("column_name")
    lname = F.lower(name)
    exact_pos = F.array_position(F.array(*[F.lit(c) for c in candidates]), name)
    partial = F.exists(F.array(*[F.lit(c.lower()) for c in candidates]),
                       lambda c: F.instr(lname, c) > 0)
    valid = F.col("is_binary") & (F.col("rate") >= MIN_CTR) & (F.col("rate") <= MAX_CTR)
    valid = F.coalesce(valid, F.lit(False))
    stage = (F.when((exact_pos > 0) & valid, 1).when(partial & valid, 2)
             .when(F.col("is_binary"), 3))
    score = F.when(F.col("is_binary"), _score(F.col("rate")))
    t = st.select("ordinal", "column_name", "is_binary", F.round("rate", 6).alias("rate"),
                  exact_pos.cast("int").alias("exact_rank"), partial.alias("partial_match"),
                  stage.alias("stage"), F.round(score, 6).alias("score"))
    # order of preference: stage, then list position (1) / column order (2) / -score then column order (3)
    pref = Window.orderBy(F.col("stage").asc_nulls_last(),
                          F.when(F.col("stage") == 1, F.col("exact_rank")).otherwise(0),
                          F.when(F.col("stage") == 3, -F.col("score")).otherwise(0.0),
                          "ordinal")
    return t.withColumn("selected", F.coalesce((F.row_number().over(pref) == 1) & F.col("stage").isNotNull(),
                                               F.lit(False)))


def confirm_label(df: DataFrame, provided: str | None = "clicked",
                  candidates: Sequence[str] = CONFIRM_CANDIDATES) -> DataFrame:
    """The provided label if it has exactly two distinct values within
    {0,1} (no rate bounds), else the first such candidate; default 'clicked'."""
    st = column_stats(df)
    ok = (F.col("n_binary_values") == 2) & F.col("is_binary")
    names = ([provided] if provided else []) + list(candidates)
    pos = F.array_position(F.array(*[F.lit(c) for c in names]), F.col("column_name"))
    hit = st.where(ok & (pos > 0)).select("column_name", pos.alias("p"))
    best = hit.agg(F.min_by("column_name", "p").alias("label"))
    return best.select(F.coalesce("label", F.lit("clicked")).alias("label"))


def feature_types(df: DataFrame, expected: Sequence[str] = EXPECTED_CATEGORICAL,
                  patterns: Sequence[str] = CONTINUOUS_PATTERNS,
                  max_values: int = MAX_CATEGORY_VALUES) -> DataFrame:
    """B4 as a table ``(column_name, ordinal, kind, matched, n_distinct)``.

    Categorical: for each expected name, the first column (table order) whose
    lower-case name contains it and has fewer than ``max_values`` distinct
    non-null values. Continuous: any other column whose name contains a
    pattern and whose type is int/long/float/double.
    """
    need = [f.name for f in df.schema.fields if any(e in f.name.lower() for e in expected)]
    st = column_stats(df, distinct_for=need)
    rows = []
    for i, e in enumerate(expected):
        rows.append(F.struct(F.lit(i).alias("e_idx"), F.lit(e).alias("expected")))
    exp = F.array(*rows)
    typed = {f.name: isinstance(f.dataType, INT_FLOAT_TYPES) for f in df.schema.fields}
    st = st.withColumn("int_float", F.element_at(
        F.create_map(*[x for n, b in typed.items() for x in (F.lit(n), F.lit(b))]), F.col("column_name")))
    cand = st.select("*", F.explode(exp).alias("e")).where(
        F.instr(F.lower("column_name"), F.col("e.expected")) > 0) \
        .where(F.col("n_distinct") < max_values)
    w = Window.partitionBy("e.e_idx").orderBy("ordinal")
    cat = cand.withColumn("rk", F.row_number().over(w)).where("rk = 1") \
        .select("column_name", "e", F.col("e.expected").alias("matched"))
    # a column can win several expected names; it is listed once, under its first
    cat = cat.groupBy("column_name").agg(F.min_by("matched", "e.e_idx").alias("matched"))
    j = st.join(cat, "column_name", "left")
    pat = F.exists(F.array(*[F.lit(p) for p in patterns]), lambda p: F.instr(F.col("column_name"), p) > 0)
    kind = (F.when(F.col("matched").isNotNull(), "categorical")
            .when(pat & F.col("int_float"), "continuous").otherwise("other"))
    return j.select("column_name", "ordinal", kind.alias("kind"), "matched", "n_distinct")


def name_matched(columns: Sequence[str], expected: Sequence[str] = EXPECTED_CATEGORICAL) -> list[str]:
    return [c for c in columns if any(e in c.lower() for e in expected)]


def profile(df: DataFrame, expected: Sequence[str] = EXPECTED_CATEGORICAL) -> dict[str, dict]:
    """One aggregate job -> per-column statistics on the driver (one small
    record per column: the schema width bounds it). Distinct counts and
    infinity flags only for the name-matched categorical candidates."""
    cand = name_matched(df.columns, expected)
    rows = column_stats(df, distinct_for=cand, inf_for=cand).collect()
    return {r["column_name"]: r.asDict() for r in rows}


def confirm_label_from(prof: dict[str, dict], provided: str | None = "clicked",
                       candidates: Sequence[str] = CONFIRM_CANDIDATES) -> str:
    """G7 decided from a profile (same rule as ``confirm_label``)."""
    for name in ([provided] if provided else []) + list(candidates):
        r = prof.get(name)
        if r and r["is_binary"] and r["n_binary_values"] == 2:
            return name
    return "clicked"


def categorical_from(prof: dict[str, dict], columns: Sequence[str],
                     expected: Sequence[str] = EXPECTED_CATEGORICAL,
                     max_values: int = MAX_CATEGORY_VALUES) -> list[str]:
    """B4 categorical list decided from a profile, in table order."""
    chosen: list[str] = []
    for e in expected:
        for c in columns:
            r = prof.get(c)
            if e in c.lower() and r and r["n_distinct"] is not None and r["n_distinct"] < max_values:
                if c not in chosen:
                    chosen.append(c)
                break
    return [c for c in columns if c in chosen]
