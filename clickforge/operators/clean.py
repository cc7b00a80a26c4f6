"""Projection and cleaning operators.

Each is a single ``select`` so a 130-column table gets one projection node
instead of a chain of ``withColumn`` calls.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickforge.functions import exprs as X

KEY = "row_key"
# Fixed values from the reference: column kept although its name holds "id".
KEEP_ID_COLUMNS = ("inventory_id",)
SEQUENCE_COLUMN = "seq"


def id_like_columns(columns: Sequence[str]) -> list[str]:
    """Names holding 'id' (any case), except ``inventory_id``."""
    return [c for c in columns if "id" in c.lower() and c.lower() not in KEEP_ID_COLUMNS]


def drop_unused(train: DataFrame, test: DataFrame, key: str = KEY) -> tuple[DataFrame, DataFrame]:
    """B2 + B3: drop ``seq`` on both sides and id-like columns found on train."""
    drop = [c for c in id_like_columns(train.columns) if c != key]
    train = train.drop(SEQUENCE_COLUMN, *drop)
    test = test.drop(SEQUENCE_COLUMN, *drop)
    return train, test


def fill_missing(train: DataFrame, test: DataFrame, keep: Sequence[str] = (KEY,)) -> tuple[DataFrame, DataFrame]:
    """A training column that the test side lacks cannot be prepared on both;
    it becomes 0.0 on both sides. Decided from the schemas."""
    lost = [c for c in train.columns if c not in test.columns and c not in keep]
    return train.withColumns({c: F.lit(0.0) for c in lost}), test.withColumns({c: F.lit(0.0) for c in lost})


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, T.NumericType)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Names of numeric columns (schema only, no data read)."""
    return [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name not in exclude]


def finite_clean(df: DataFrame, cols: Sequence[str] | None = None, mode: str = "train",
                 key: str = KEY) -> DataFrame:
    """B9 (``mode='train'``: ±inf -> 0, NaN/NULL -> 0) or B10 (``mode='score'``:
    NaN/NULL -> 0, +inf -> 1e6, -inf -> -1e6), then B11 float cast."""
    cols = list(cols) if cols is not None else numeric_columns(df, exclude=[key])
    pos, neg = (0.0, 0.0) if mode == "train" else (1e6, -1e6)
    keep = [c for c in df.columns if c not in cols]
    return df.select(*keep, *[X.finite_or(F.col(c).cast("double"), 0.0, pos, neg)
                              .cast("float").alias(c) for c in cols])


def align_features(df: DataFrame, feature_order: Sequence[str], key: str | None = KEY) -> DataFrame:
    """Training column order; missing -> 0.0, extra dropped."""
    have = set(df.columns)
    cols = [(F.col(c) if c in have else F.lit(0.0)).cast("float").alias(c) for c in feature_order]
    return df.select(*([key] if key and key in have else []), *cols)


def minimal_features(train: DataFrame, test: DataFrame, label: str,
                     key: str = KEY) -> tuple[DataFrame, DataFrame]:
    """Numeric columns common to both sides, NULL -> 0 (train order)."""
    tr = train.drop(label)
    tr, te = drop_unused(tr, test, key)
    common = [c for c in numeric_columns(tr, [key]) if c in set(numeric_columns(te, [key]))]
    sel = lambda d: d.select(key, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in common])
    return sel(tr), sel(te)


def clip_probability(c: Column, serving: bool = False) -> Column:
    """[1e-15, 1-1e-15] for models/metrics, [1e-4, 0.9999] for serving."""
    return X.clip(c, 0.0001, 0.9999) if serving else X.clip(c, 1e-15, 1 - 1e-15)


# Fixed values from the reference: constant predictions used when a model fails.
FAILED_PREDICTION = 0.0191
SERVING_BASELINE = 0.0201


def default_prediction(c: Column, default: float = FAILED_PREDICTION) -> Column:
    """Missing prediction -> constant."""
    return F.coalesce(c, F.lit(default))


def alignment_check(left: DataFrame, right: DataFrame, key: str = KEY) -> DataFrame:
    """Keyed full-outer check of two tables that must hold the same keys.
    One row: rows on each side, unmatched on each side, and ``aligned``."""
    l = left.select(F.col(key).alias("__k")).withColumn("__l", F.lit(1))
    r = right.select(F.col(key).alias("__k")).withColumn("__r", F.lit(1))
    j = l.join(r, "__k", "full_outer")
    out = j.agg(F.count("__l").alias("left_rows"), F.count("__r").alias("right_rows"),
                F.count(F.when(F.col("__r").isNull(), 1)).alias("left_only"),
                F.count(F.when(F.col("__l").isNull(), 1)).alias("right_only"))
    return out.withColumn("aligned", (F.col("left_only") == 0) & (F.col("right_only") == 0))
