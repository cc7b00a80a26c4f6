"""Session helpers: a tuned local session for tests/bench, and the shared
checkpoint folder taken from the cluster configuration."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every clickforge job relies on.
SESSION_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "clickforge") -> SparkSession:
    """Local session used by tests and bench (a cluster brings its own conf)."""
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", "8g"))
    for k, v in SESSION_DEFAULTS.items():
        b = b.config(k, v)
    active = SparkSession.getActiveSession()
    if active is None or not active.conf.get("spark.checkpoint.dir", None):
        # Scratch folder for local runs only; clusters name a shared one.
        b = b.config("spark.checkpoint.dir",
                     tempfile.mkdtemp(prefix="clickforge-ckpt-", dir="/tmp"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder the session names; when none is set and
    Spark runs in local mode (tests, bench, a checking harness), create a
    scratch folder for this run. A cluster without one is an error: only a
    shared folder survives the loss of an executor."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    jd = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jd.isDefined():
        return jd.get()
    if d:
        spark.sparkContext.setCheckpointDir(d)
        return d
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; configure a shared folder")
    d = tempfile.mkdtemp(prefix="clickforge-ckpt-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(d)
    return d


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this must be a shared filesystem path (HDFS/S3/ABFS); the
    library never invents a machine-local folder there.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        jd = spark.sparkContext._jsc.sc().getCheckpointDir()
        d = jd.get() if jd.isDefined() else None
    if not d:
        raise RuntimeError("spark.checkpoint.dir is not set; configure a shared folder")
    jd = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not jd.isDefined():
        spark.sparkContext.setCheckpointDir(d)
    return d


_open_runs: list[list[str]] = []


def materialize(df):
    """Cut lineage by writing ``df`` as parquet under the shared checkpoint
    folder and reading it back: columnar, compressed, with exact statistics
    for the optimizer (AQE, broadcast decisions). A lost executor does not
    send later stages back to the source scan. The result knows its
    ``shared_path``; see :func:`release` and :class:`run_tables`."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    if _open_runs:
        _open_runs[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def release(spark, *paths: str) -> None:
    """Delete tables that :func:`materialize` wrote, once nothing reads them."""
    conf = spark._jsc.hadoopConfiguration()
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


class run_tables:
    """``with run_tables(spark):`` deletes on leaving every table that
    :func:`materialize` wrote inside; results must have been consumed by then."""

    def __init__(self, spark):
        self.spark = spark

    def __enter__(self) -> list[str]:
        _open_runs.append([])
        return _open_runs[-1]

    def __exit__(self, *_) -> None:
        release(self.spark, *_open_runs.pop())
