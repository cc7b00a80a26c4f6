"""Impression, prediction and request tables derived from the given parquet
tables (FIXTURES.md §3). Each is a lazy projection of one scan, so Catalyst
prunes the columns a downstream operator does not read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickforge.sources.tables import read_table

# Fixed values of the test fixtures: test split = row keys starting with one of these.
TEST_KEY_PREFIXES = ("d", "e", "f")


def _s(c) -> Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per ad impression, keyed by ``row_key`` (unique md5 of six columns)."""
    li = read_table(spark, sf_dir, "lineitem")
    day = F.unix_date(F.to_date("l_shipdate"))
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    row_key = F.md5(F.concat_ws("-", _s("l_orderkey"), _s("l_linenumber"), _s("l_partkey"),
                                _s("l_suppkey"), _s(day), _s(cents)))
    return li.select(
        row_key.alias("row_key"),
        ((F.col("l_quantity") >= 48) & (F.col("l_discount") >= 0.07)).cast("int").alias("clicked"),
        F.when(F.col("l_returnflag") == "A", "1.0").when(F.col("l_returnflag") == "R", "2.0")
         .alias("gender"),
        _s("l_linenumber").alias("age_group"),
        F.col("l_suppkey").alias("inventory_id"),
        F.dayofweek("l_shipdate").cast("int").alias("day_of_week"),
        (F.col("l_partkey") % 24).cast("int").alias("hour"),
        F.col("l_extendedprice").alias("feat_a_1"),
        F.col("l_discount").alias("feat_a_2"),
        F.col("l_tax").alias("feat_a_3"),
        (F.col("l_partkey") % 50).cast("double").alias("history_b_1"),
        (F.col("l_extendedprice") / 1000).alias("history_b_2"),
        F.when(F.col("l_linenumber") == 3, F.lit(None).cast("double"))
         .otherwise(F.col("l_tax") * 100).alias("history_b_3"),
        F.col("l_orderkey").alias("seq"),
        F.col("l_returnflag").alias("ad_id_text"),
    )


def is_test_row(key: str = "row_key") -> Column:
    return F.substring(F.col(key), 1, 1).isin(*TEST_KEY_PREFIXES)


def split_train_test(df: DataFrame, key: str = "row_key") -> tuple[DataFrame, DataFrame]:
    """Deterministic train/test split by key prefix (a filter, no shuffle)."""
    return df.filter(~is_test_row(key)), df.filter(is_test_row(key))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide prediction table: three score columns per impression."""
    imp = impressions(spark, sf_dir)
    m1 = 0.001 + F.col("feat_a_2") * 0.3
    m2 = F.least(F.col("feat_a_1") / 2000000.0, F.lit(0.99))
    return imp.select("row_key", "clicked", F.col("age_group").alias("segment"),
                      m1.alias("p_m1"), m2.alias("p_m2"), (0.5 * m1 + 0.5 * m2).alias("p_m3"))


MODEL_COLUMNS = ("p_m1", "p_m2", "p_m3")


def long_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form ``(row_key, clicked, segment, model, p)`` via unpivot (no shuffle)."""
    wide = predictions(spark, sf_dir)
    return wide.unpivot(["row_key", "clicked", "segment"], list(MODEL_COLUMNS), "model", "p") \
        .withColumn("model", F.regexp_replace("model", "^p_", ""))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat request table derived from ``events``."""
    return requests_from_events(read_table(spark, sf_dir, "events"))


def requests_from_events(ev: DataFrame) -> DataFrame:
    """Request projection of an events table or stream (stateless)."""
    k = F.get_json_object("props", "$.k").cast("int")
    page = (F.when(F.col("event_type") == "view", "home")
            .when(F.col("event_type") == "click", "product")
            .when(F.col("event_type") == "purchase", "checkout")
            .when(F.col("event_type") == "signup", "category").otherwise("weird"))
    return ev.select(
        "event_id", "ts",
        F.concat(F.lit("user_"), _s("user_id")).alias("user_id"),
        # ad 7 is launched anew every day, so later requests hold ads that earlier ones lack
        F.concat(F.lit("ad_"), _s(F.col("event_id") % 20), F.when(F.col("event_id") % 20 == 7, F.concat(
            F.lit("_"), F.to_date("ts").cast("string"))).otherwise(F.lit(""))).alias("ad_id"),
        F.when(F.col("event_id") % 3 == 0, "Mobile").when(F.col("event_id") % 3 == 1, "desktop")
         .alias("device"),
        page.alias("page"),
        F.hour("ts").cast("int").alias("hour"),
        (1 + F.col("event_id") % 5).cast("int").alias("position"),
        F.col("value").alias("bid_amount"),
        ((F.col("event_type") == "click") & (k < 10)).cast("int").alias("clicked"),
        k.alias("k"),
    )


def context_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests whose context is JSON text with keys that vary from row to row:
    those of ``events.props`` and some more, a few contexts broken or missing."""
    i = F.col("event_id")
    text = F.concat(
        F.expr("substring(props, 1, length(props) - 1)"), F.lit(', "value": '), F.coalesce(_s("value"), F.lit("null")),
        F.lit(', "referrer": "'), F.col("event_type"), F.lit('", "returning": '), F.when(i % 2 == 0, "true").otherwise("false"),
        F.lit(', "campaign_'), _s(i % 3), F.lit('": "c'), _s(i % 7), F.lit('", "hour": 5'),
        F.when(i % 4 == 0, ', "feat_e_1": "70"').otherwise(""), F.lit("}"))
    broken = F.when(i % 11 == 3, "k=1").when(i % 13 == 5, None).otherwise(text)
    return read_table(spark, sf_dir, "events").select("event_id", broken.alias("context"))
