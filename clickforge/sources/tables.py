"""Scans, sinks and dataset checks.

Reads go through ``spark.read`` so column pruning and predicate pushdown reach
the parquet scan; nothing here materialises a table on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str, skip_corrupt: bool = False) -> DataFrame:
    """A1: parquet scan, its splits as the files give them (a caller that wants
    others repartitions). ``skip_corrupt`` is the reference's "log and skip an
    unreadable row group" behaviour, made explicit (off by default)."""
    reader = spark.read
    if skip_corrupt:
        reader = reader.option("ignoreCorruptFiles", "true")
    return reader.parquet(table_path(sf_dir, name))


def read_with_manifest(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """A1: the readable rows of a folder of Parquet files, and its manifest: each
    file listed there, its bytes, the rows read and whether none could be
    (``skipped``: unreadable, or empty). Listing reads no file's content."""
    # the option holds for this scan alone; files of a given schema need no footer to be planned
    rows = spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(path)
    listed = (spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
              .select(F.regexp_replace("path", "^file:/+", "/").alias("file"), F.col("length").alias("bytes")))
    read = rows.groupBy(F.regexp_replace("_metadata.file_path", "^file:/+", "/").alias("file")).agg(F.count(F.lit(1)).alias("rows"))
    manifest = listed.join(read, "file", "left").select("file", "bytes", F.coalesce("rows", F.lit(0)).alias("rows"),
                                                        F.col("rows").isNull().alias("skipped"))
    return rows, manifest


def load_pair(train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A2: both sides must be non-empty. ``isEmpty`` reads at most one row."""
    if train.isEmpty():
        raise ValueError("training table is empty")
    if test.isEmpty():
        raise ValueError("test table is empty")
    return train, test


def sample_rows(df: DataFrame, n: int, key: str = "row_key", seed: int = 42) -> DataFrame:
    """A3: exact-n reproducible sample.

    Rows are ranked by ``md5(key || seed)``, a pure function of the row, so the
    sample does not depend on partitioning and survives recomputation.
    ``orderBy(...).limit(n)`` plans as a TakeOrderedAndProject: each task keeps
    its own top n and only n rows per task reach the final merge.
    """
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed))))
    return df.withColumn("_h", h).orderBy("_h").limit(n).drop("_h")


# Fixed values from the reference configuration (dataset requirement check).
EXPECTED_TRAIN_ROWS = 10_704_179
EXPECTED_TEST_ROWS = 1_527_298
MIN_TRAIN_MB = 1000
MIN_TEST_MB = 100


def dataset_check(tables: dict[str, DataFrame],
                  expected_rows: dict[str, int] | None = None,
                  min_bytes: dict[str, int] | None = None) -> DataFrame:
    """One row per table with row count, bytes on disk and pass flags.

    Bytes come from the hidden ``_metadata`` column (distinct file sizes), so
    the check is a single aggregate per table, not a driver-side file walk.
    """
    expected_rows = expected_rows or {}
    min_bytes = min_bytes or {}
    parts = []
    for name, df in tables.items():
        files = df.select(F.col("_metadata.file_path").alias("f"),
                          F.col("_metadata.file_size").alias("s"))
        stats = files.groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.first("s").alias("s")) \
            .agg(F.sum("n").alias("row_count"), F.sum("s").alias("bytes"))
        exp = expected_rows.get(name)
        mb = min_bytes.get(name)
        parts.append(stats.select(
            F.lit(name).alias("table_name"),
            F.coalesce("row_count", F.lit(0)).cast("long").alias("row_count"),
            F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"),
            (F.lit(True) if exp is None else F.col("row_count") == F.lit(exp)).alias("rows_ok"),
            (F.lit(True) if mb is None else F.col("bytes") >= F.lit(mb)).alias("size_ok"),
        ))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


ID_TEMPLATE_SCHEMA = T.StructType([T.StructField("ID", T.StringType()),
                                   T.StructField("clicked", T.DoubleType())])


def read_id_template(spark: SparkSession, path: str) -> DataFrame:
    """Submission template (``ID, clicked``) with a declared schema."""
    return spark.read.option("header", True).schema(ID_TEMPLATE_SCHEMA).csv(path)


def write_submission(df: DataFrame, path: str) -> None:
    """``ID, clicked`` CSV with header (one folder of part files)."""
    df.select("ID", "clicked").write.mode("overwrite").option("header", True).csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """JSON lines report."""
    df.write.mode("overwrite").json(path)
