"""Experiment tracking.

The experiment *table* (parquet, append mode) is the store; the reference's
fixed-width text log is kept as an interchange format that Spark writes and
reads back. Entries are separated so that each text record is one complete
entry (header and body together), so parsing is a per-record projection
with ``regexp_extract`` — no pairing of lines, no single-task pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values from the reference log format.
RULE = "=" * 70
ENTRY_SEP = "\n" + RULE + "\n["          # starts every entry, and only entries
TS_FORMAT = "yyyy-MM-dd HH:mm:ss"
DEFAULT_NOTES = "Mode: Full"


def experiment_rows(metrics: DataFrame, experiment_num: int | Column, run_model: str,
                    params: dict[str, str], pred_stats: DataFrame | None = None,
                    execution_time: float | None = None, notes: str = DEFAULT_NOTES) -> DataFrame:
    """O1: one experiment as table rows (one per evaluated model)."""
    pmap = F.create_map(*[x for k, v in sorted(params.items()) for x in (F.lit(k), F.lit(str(v)))])
    num = experiment_num if isinstance(experiment_num, Column) else F.lit(experiment_num)
    base = metrics.select(
        num.cast("int").alias("experiment_num"),
        F.date_format(F.current_timestamp(), TS_FORMAT).alias("ts"),
        F.lit(run_model).alias("run_model"), F.lit(notes).alias("notes"), pmap.alias("params"),
        F.col("model"), "auc", "ap", "actual_ctr", "predicted_ctr", "ctr_bias")
    if pred_stats is not None:
        one = pred_stats.agg(F.count(F.lit(1)).alias("__rows"), *[
            F.first(c).alias(f"pred_{c}") for c in ("mean", "std", "min", "max")])
        one = one.where(F.assert_true(F.col("__rows") == 1, F.lit("one row of prediction statistics is expected")).isNull())
        base = base.crossJoin(F.broadcast(one.drop("__rows")))  # one row
    else:
        base = base.select("*", *[F.lit(None).cast("double").alias(c)
                                  for c in ("pred_mean", "pred_std", "pred_min", "pred_max")])
    return base.withColumn("execution_time", F.lit(execution_time).cast("double")) \
        .withColumn("successful_models", F.count(F.lit(1)).over(Window.partitionBy("experiment_num")))


def append_experiment(rows: DataFrame, table_path: str) -> None:
    """Append to the experiment table."""
    rows.write.mode("append").parquet(table_path)


def next_experiment_num(spark: SparkSession, table_path: str) -> int:
    """O3 on the table: highest number + 1; 1 when there is no table yet. Any
    other failure to read it is an error, never a new count."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table_path)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return 1
    r = spark.read.parquet(table_path).agg(F.max("experiment_num").alias("m")).first()
    return int(r["m"] or 0) + 1


def claim_experiment_num(spark: SparkSession, table_path: str) -> int:
    """O3 for several writers: the next number that nobody has claimed. A claim is
    the exclusive creation of a marker beside the table, so of two writers that
    saw the same highest number one goes on to the following one."""
    jvm, num = spark._jvm, next_experiment_num(spark, table_path)
    fs = jvm.org.apache.hadoop.fs.Path(table_path).getFileSystem(spark._jsc.hadoopConfiguration())
    while True:
        marker = jvm.org.apache.hadoop.fs.Path(f"{table_path.rstrip('/')}_numbers/{num}")
        try:
            fs.create(marker, False).close()
            return num
        except Py4JJavaError:
            if not fs.exists(marker):  # not a clash: the folder can't be written
                raise
            num += 1


def _fmt(c: str, digits: int) -> Column:
    return F.when(F.col(c).isNull() | F.isnan(c), F.lit("nan")).otherwise(F.format_string(f"%.{digits}f", F.col(c)))


def render_text(table: DataFrame) -> DataFrame:
    """Text form of each experiment (one ``value`` row per entry), in the
    reference layout: rules, header, model, notes, parameters, per-model
    results, prediction statistics, execution info. Grouping is by
    experiment, whose size is the number of models evaluated in it."""
    model_block = F.concat(
        F.lit("  ["), F.col("model"), F.lit("]\n"),
        F.lit("    AUC: "), _fmt("auc", 4), F.lit("\n"),
        F.lit("    AP: "), _fmt("ap", 4), F.lit("\n"),
        F.lit("    Actual CTR: "), _fmt("actual_ctr", 6), F.lit("\n"),
        F.lit("    Predicted CTR: "), _fmt("predicted_ctr", 6), F.lit("\n"),
        F.lit("    CTR Bias: "), _fmt("ctr_bias", 6), F.lit("\n"))
    params_text = F.array_join(F.transform(F.array_sort(F.map_entries("params")),
                                           lambda e: F.concat(F.lit("  "), e["key"], F.lit(": "), e["value"])),
                               "\n")
    g = table.groupBy("experiment_num").agg(
        F.first("ts").alias("ts"), F.first("run_model").alias("run_model"), F.first("notes").alias("notes"),
        F.first("params").alias("params"),
        F.array_sort(F.collect_list(F.struct("model", model_block.alias("block")))).alias("blocks"),
        F.first("pred_mean").alias("pred_mean"), F.first("pred_std").alias("pred_std"),
        F.first("pred_min").alias("pred_min"), F.first("pred_max").alias("pred_max"),
        F.first("execution_time").alias("execution_time"),
        F.first("successful_models").alias("successful_models"))
    stats = F.when(F.col("pred_mean").isNotNull(), F.concat(
        F.lit("  [Prediction Stats]\n"),
        F.lit("    Mean: "), _fmt("pred_mean", 6), F.lit("\n"),
        F.lit("    Std: "), _fmt("pred_std", 6), F.lit("\n"),
        F.lit("    Min: "), _fmt("pred_min", 6), F.lit("\n"),
        F.lit("    Max: "), _fmt("pred_max", 6), F.lit("\n\n"))).otherwise(F.lit(""))
    exe = F.concat(
        F.when(F.col("execution_time").isNotNull(),
               F.concat(F.lit("  Execution Time: "), _fmt("execution_time", 1), F.lit("s\n"))).otherwise(F.lit("")),
        F.lit("  Successful Models: "), F.col("successful_models").cast("string"), F.lit("\n"))
    text = F.concat(
        F.lit("\n" + RULE + "\n["), F.col("ts"), F.lit("] Experiment #"), F.col("experiment_num").cast("string"),
        F.lit("\n" + RULE + "\n\n"),
        F.lit("Model: "), F.col("run_model"), F.lit("\n"), F.lit("Notes: "), F.col("notes"), F.lit("\n\n"),
        F.lit("--- Key Parameters ---\n"), params_text, F.lit("\n\n"),
        F.lit("--- Results ---\n\n"),
        F.array_join(F.transform("blocks", lambda b: F.concat(b["block"], F.lit("\n"))), ""),
        stats, exe, F.lit("\n" + RULE + "\n"))
    return g.select("experiment_num", text.alias("value"))


def write_text_log(table: DataFrame, path: str) -> None:
    """Write the text log: entries concatenated in experiment order (the
    per-entry strings are small; ordering is by the entry number)."""
    render_text(table).orderBy("experiment_num").select("value") \
        .write.mode("overwrite").text(path)


def read_text_log(spark: SparkSession, path: str) -> DataFrame:
    """One record per entry (the separator opens every entry)."""
    raw = spark.read.option("lineSep", ENTRY_SEP).text(path)
    return raw.where(F.col("value").contains("] Experiment #"))


def number(text: Column, label: str) -> Column:
    """What the first ``label:`` is followed by; "nan" and anything else that is no number is NULL."""
    token = F.regexp_extract(text, label + r": (\S+)", 1)
    return F.when(token.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), token.try_cast("double"))


def parse_entries(entries: DataFrame) -> DataFrame:
    """Entry text -> ``(experiment_num, ts, run_model, notes, model, auc,
    ap, actual_ctr, predicted_ctr, ctr_bias, first_auc)``; one row per model
    block. ``first_auc`` is the first AUC in the entry (what L3 ranks by)."""
    v = F.col("value")
    head = entries.select(
        F.regexp_extract(v, r"Experiment #(\d+)", 1).cast("int").alias("experiment_num"),
        F.regexp_extract(v, r"^([^\]]*)\]", 1).alias("ts"),
        F.regexp_extract(v, r"\nModel: ([^\n]*)", 1).alias("run_model"),
        F.regexp_extract(v, r"\nNotes: ([^\n]*)", 1).alias("notes"),
        number(v, "AUC").alias("first_auc"),
        F.regexp_extract(v, r"Successful Models: (\d+)", 1).cast("int").alias("successful_models"),
        F.regexp_extract(v, r"Execution Time: ([0-9.]+)s", 1).try_cast("double").alias("execution_time"),
        F.split(F.regexp_extract(v, r"--- Results ---\n\n([\s\S]*)", 1), r"\n  \[").alias("blocks"))
    b = head.select("*", F.posexplode("blocks").alias("pos", "blk")).drop("blocks")
    blk = F.col("blk")
    num = lambda label: number(blk, label)
    out = b.select(
        "experiment_num", "ts", "run_model", "notes", "first_auc", "successful_models", "execution_time",
        F.regexp_extract(blk, r"^\s*\[?([^\]\n]*)\]", 1).alias("model"),
        num("AUC").alias("auc"), num("AP").alias("ap"), num("Actual CTR").alias("actual_ctr"),
        num("Predicted CTR").alias("predicted_ctr"), num("CTR Bias").alias("ctr_bias"))
    # blocks of models begin with an AUC line, whatever its value
    return out.where(blk.rlike(r"\n    AUC: ") & (F.col("model") != "Prediction Stats"))


def experiment_count(entries: DataFrame) -> DataFrame:
    """O3: number of logged experiments."""
    return entries.agg(F.count(F.lit(1)).alias("n_experiments"))


def best_experiment(parsed: DataFrame) -> DataFrame:
    """L3: the experiment with the highest *first* AUC of its entry."""
    e = parsed.select("experiment_num", "first_auc").distinct()
    return e.agg(F.max_by("experiment_num", "first_auc").alias("best_experiment"),
                 F.max("first_auc").alias("best_auc"))


def recent_experiments(parsed: DataFrame, n: int = 5) -> DataFrame:
    """L4: the last ``n`` experiments (a top-n report)."""
    e = parsed.select("experiment_num", "run_model").distinct()
    return e.orderBy(F.col("experiment_num").desc()).limit(n)


def export_json(table: DataFrame, path: str) -> None:
    """One JSON object per experiment with its model results nested."""
    g = table.groupBy("experiment_num", "ts", "run_model", "notes").agg(
        F.first("params").alias("params"),
        F.collect_list(F.struct("model", "auc", "ap", "actual_ctr", "predicted_ctr", "ctr_bias"))
        .alias("model_performances"))
    g.write.mode("overwrite").json(path)


def log_and_parse(runs: Sequence[tuple[str, dict, DataFrame, DataFrame | None]], folder: str,
                  spark: SparkSession) -> DataFrame:
    """Log several runs (model name, params, metric rows, prediction stats)
    into a fresh experiment table + text log under ``folder`` and parse the
    text back."""
    table = f"{folder}/table"
    for run_model, params, metrics, stats in runs:
        num = next_experiment_num(spark, table)
        append_experiment(experiment_rows(metrics, num, run_model, params, stats), table)
    write_text_log(spark.read.parquet(table), f"{folder}/text")
    return parse_entries(read_text_log(spark, f"{folder}/text"))
