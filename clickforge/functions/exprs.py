"""Column expressions shared by the operators.

All are built-in Spark SQL functions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A number as pandas ``to_numeric`` reads it: optional sign, digits with an
# optional fraction or a bare fraction, optional exponent, outer blanks.
# Spark's own cast is looser (it accepts '1d', '1f'), hence this guard.
NUMBER_RE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INF_RE = r"(?i)^\s*[+-]?(inf|infinity)\s*$"
NAN_RE = r"(?i)^\s*[+-]?nan\s*$"

INF = float("inf")


def to_text(c: Column) -> Column:
    return c.cast("string")


def parse_number(text: Column) -> Column:
    """Text -> double the pandas way: numbers and ±inf parse, NaN/other -> NULL."""
    t = F.trim(text)
    return (F.when(text.rlike(NUMBER_RE), t.try_cast("double"))
            .when(text.rlike(INF_RE), F.when(t.startswith("-"), F.lit(-INF)).otherwise(F.lit(INF))))


def category_text(c: Column) -> Column:
    """B5 text form: NULL -> 'missing', literal 'None' -> 'missing', every
    literal '.0' removed (so '1.05' becomes '15', as in the reference)."""
    t = F.coalesce(to_text(c), F.lit("missing"))
    t = F.replace(t, F.lit("None"), F.lit("missing"))
    return F.replace(t, F.lit(".0"), F.lit(""))


def category_int(c: Column) -> Column:
    """Category text -> int32 code; unparsable -> -1 (truncation toward 0)."""
    v = parse_number(category_text(c))
    return F.coalesce(F.when(~F.isnan(v), v).try_cast("int"), F.lit(-1))


def category_has_inf(c: Column) -> Column:
    """True for a value that makes the reference keep the whole column as text."""
    return category_text(c).rlike(INF_RE)


def numeric_value(c: Column, dtype: str) -> Column:
    """Parse any column to double; NULL/NaN -> 0 is applied by the caller."""
    if dtype in ("string",):
        return parse_number(c)
    if dtype == "boolean":
        return c.cast("double")
    return c.cast("double")


def finite_or(c: Column, nan: float = 0.0, pos: float = 0.0, neg: float = 0.0) -> Column:
    """NULL/NaN -> ``nan``, +inf -> ``pos``, -inf -> ``neg``."""
    return (F.when(c.isNull() | F.isnan(c), F.lit(nan))
            .when(c == F.lit(INF), F.lit(pos))
            .when(c == F.lit(-INF), F.lit(neg))
            .otherwise(c))


def row_stats(cols: Sequence[str]) -> dict[str, Column]:
    """X-1/X-2: null-skipping row mean, sample std, max, min across columns,
    via one array and higher-order functions (no per-column expression blow-up)."""
    arr = F.filter(F.array(*[F.col(c).cast("double") for c in cols]),
                   lambda x: x.isNotNull() & ~F.isnan(x))
    n = F.size(arr)
    s = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)
    mean = F.when(n > 0, s / n)
    ss = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + (x - s / n) * (x - s / n))
    std = F.when(n > 1, F.sqrt(ss / (n - 1)))
    return {"mean": mean, "std": std, "max": F.array_max(arr), "min": F.array_min(arr)}


def with_row_stats(df: DataFrame, groups: dict[str, Sequence[str]]) -> DataFrame:
    """X-1/X-2: :func:`row_stats` of each named group of columns, as ``<name>_mean`` and so
    on. Array, sum and mean are columns of steps of their own: written into the next
    function, as there, they are computed for each element again."""
    squares = lambda m: lambda acc, x: acc + (x - m) * (x - m)
    arr, n, s, mean, ss = ({g: f"__{part}_{g}" for g in groups} for part in ("arr", "n", "s", "mean", "ss"))
    out = df.select("*", *[F.filter(F.array(*[F.col(c).cast("double") for c in cols]), lambda x: x.isNotNull() & ~F.isnan(x)).alias(arr[g])
                           for g, cols in groups.items()])
    out = out.select("*", *[x for g in groups for x in (
        F.size(arr[g]).alias(n[g]), F.aggregate(arr[g], F.lit(0.0), lambda acc, x: acc + x).alias(s[g]))])
    out = out.select("*", *[F.when(F.col(n[g]) > 0, F.col(s[g]) / F.col(n[g])).alias(mean[g]) for g in groups])
    out = out.select("*", *[F.aggregate(arr[g], F.lit(0.0), squares(F.col(mean[g]))).alias(ss[g]) for g in groups])
    return out.select(*df.columns, *[x for g in groups for x in (
        F.col(mean[g]).alias(f"{g}_mean"), F.when(F.col(n[g]) > 1, F.sqrt(F.col(ss[g]) / (F.col(n[g]) - 1))).alias(f"{g}_std"),
        F.array_max(arr[g]).alias(f"{g}_max"), F.array_min(arr[g]).alias(f"{g}_min"))])


def time_period(hour: Column) -> Column:
    """X-3: right-closed bins [0,6] (6,12] (12,18] (18,24] -> 0..3, else NULL."""
    h = hour.cast("double")
    return (F.when((h >= 0) & (h <= 6), 0).when((h > 6) & (h <= 12), 1)
            .when((h > 12) & (h <= 18), 2).when((h > 18) & (h <= 24), 3)).cast("float")


def md5_mod(c: Column, m: int = 1_000_000) -> Column:
    """X-6: ``int(md5(text), 16) % m`` over all 128 bits.

    The digest is read as four 32-bit words w0..w3 and reduced Horner-style,
    ``r = (r * 2^32 + w) mod m``; with ``m < 2^31`` every intermediate fits
    in a signed 64-bit long, so this stays in plain long arithmetic inside
    whole-stage codegen (no decimals, no UDF).
    """
    assert 0 < m < 2 ** 31
    h = F.md5(c.cast("string"))
    r = F.lit(0).cast("long")
    for i in range(4):
        w = F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long")
        r = F.pmod(r * F.lit(2 ** 32) + w, F.lit(m))
    return r


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.least(c, F.lit(hi)), F.lit(lo))


def _session_tz() -> str:
    from pyspark.sql import SparkSession
    s = SparkSession.getActiveSession()
    return s.conf.get("spark.sql.session.timeZone") if s is not None else "UTC"


def ntz_as_utc(c: Column) -> Column:
    """A ``timestamp_ntz`` wall-clock value as the instant it names in UTC,
    whatever the session time zone (casting alone would use the session's)."""
    tz = _session_tz()
    t = c.cast("timestamp")
    return t if tz.upper() in ("UTC", "Z", "GMT") else F.from_utc_timestamp(t, tz)


def utc_wall_clock(c: Column) -> Column:
    """An instant rendered as its UTC wall-clock ``timestamp_ntz``."""
    tz = _session_tz()
    t = c if tz.upper() in ("UTC", "Z", "GMT") else F.to_utc_timestamp(c, tz)
    return t.cast("timestamp_ntz")


def stable_hash_mod(c: Column, m: int, method: str = "md5") -> Column:
    """X-7: a reproducible replacement for a per-process salted hash bucket.
    ``md5`` (default) matches Python/DuckDB exactly; ``xxhash`` is Spark's
    64-bit xxHash, cheaper, for jobs that need no external oracle."""
    if method == "xxhash":
        return F.pmod(F.xxhash64(c.cast("string")), F.lit(m))
    return md5_mod(c, m)
