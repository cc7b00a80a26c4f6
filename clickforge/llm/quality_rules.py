"""Quality rules whose cutoffs adapt to each language and source.

Counts of every whole text are taken with SQL functions, inside the row, and
written once. From them come integer ratios, and for each (language, source,
ratio) a mergeable quantile sketch: a histogram with 64 linear and then 32
buckets a power of two, so a quantile is at most 1/32 too small. Sketches are
plain (bucket, count) rows: partial sums merge in any order to the same result.
A ratio may lie ``spread`` times the median distance from the median on either
side, at least the ratio's margin; both medians are read from the same sketch
and hold still until half of a group is bad. A group of fewer than ``min_docs``
documents has the bounds of its language, and if that has too few as well, those
of all documents: sketches merge. A join on language and source brings the
bounds to the documents.

Cases: null or empty text has no words, fails the base rule and is not kept;
null languages and sources are groups of their own; empty tables give empty
results; repeated rows and ids are counted each; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, save

#: Ratio: expression over the counts, whether a low value fails too, and the least margin.
RATIOS = {
    "word_length": ("100 * word_chars div n_words", True, 150),
    "symbols": ("1000 * n_symbols div n_words", False, 100),
    "dup_lines": ("1000 * n_dup_lines div n_lines", False, 500),
    "repeats": ("1000 * n_repeat_words div n_words", False, 200),
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, not once a use or a loop."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column, size: int) -> Column:
    """Words that lie in windows of ``size`` words found twice or more."""

    def covered(win: Column) -> Column:
        def count(order: Column) -> Column:
            again = F.filter(F.sequence(F.lit(0), F.size(order) - 1), lambda k: (
                (order[k]["h"] == F.get(order, k - 1)["h"]) | (order[k]["h"] == F.get(order, k + 1)["h"])))
            places = F.array_sort(F.transform(again, lambda k: order[k]["i"]))
            return _let(places, lambda p: F.aggregate(
                F.transform(p, lambda x, k: F.least(F.lit(size), F.coalesce(F.get(p, k + 1) - x, F.lit(size)))),
                F.lit(0), lambda a, x: a + x))

        ordered = F.array_sort(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(win)) == F.size(win), 0).otherwise(_let(ordered, count))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = _let(hashes, lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (size - 1)),
                                                 lambda i: F.xxhash64(F.slice(h, i, size))))
    return F.when(F.size(words) < size, 0).otherwise(_let(windows, covered))


def text_counts(docs: DataFrame, window: int = 8) -> DataFrame:
    """The counts of every whole text, beside doc_id, lang and source."""
    d = documents(docs, "lang", "source")
    d = d.withColumn("words", F.array_remove(F.split("text", r"[ \t-\r]+"), ""))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    d = d.withColumn("lines", lines)
    return d.select(
        "doc_id", "lang", "source", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words"), window).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"))


def bucket(value: Column) -> Column:
    """The sketch's bucket: the value with all but its six highest bits zero."""
    low = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, low), low)


def sketches(usable: DataFrame) -> DataFrame:
    """(lang, source, ratio, value, n): how many documents fall into each bucket."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("ratio"), F.expr(e).cast("long").alias("v"))
                               for k, (e, _, _) in RATIOS.items()]))
    return (usable.select("lang", "source", each.alias("r"))
            .groupBy("lang", "source", F.col("r.ratio").alias("ratio"), bucket(F.col("r.v")).alias("value"))
            .agg(F.count("*").alias("n")))


def bounds(sketch: DataFrame, spread: int = 7, min_docs: int = 20) -> DataFrame:
    """One row a language and source: lowest and highest value that each ratio may have."""
    # level 0: language and source, 1: language, 2: all
    sketch = (sketch.withColumn("level", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
              .groupBy("level", F.when(F.col("level") < 2, F.col("lang")).alias("lang"),
                       F.when(F.col("level") < 1, F.col("source")).alias("source"), "ratio", "value")
              .agg(F.sum("n").alias("n")))
    group = ["level", "lang", "source", "ratio"]
    each = Window.partitionBy(*group)
    half = lambda order: 2 * F.sum("n").over(each.orderBy(order)) >= F.sum("n").over(each)
    first = lambda value: F.min(F.when(F.col("half"), F.col(value)))
    q = (sketch.withColumn("half", half("value")).withColumn("mid", first("value").over(each))
         .withColumn("far", F.abs(F.col("value") - F.col("mid"))).withColumn("half", half("far"))
         .groupBy(*group, "mid").agg(first("far").alias("far"), F.sum("n").alias("docs")))
    margin = F.create_map(*[x for k, (_, _, m) in RATIOS.items() for x in (F.lit(k), F.lit(m))])[F.col("ratio")]
    off = F.greatest(spread * F.col("far"), margin)
    # a bucket reaches a 32nd above its value
    q = q.select(*group, "docs", (F.col("mid") - off).alias("low"), (F.col("mid") + F.expr("mid div 32") + off).alias("high"))
    pick = lambda k, c: F.max(F.when(F.col("ratio") == k, F.col(c))).alias(f"{k}_{c}")
    names = [f"{k}_{c}" for k in RATIOS for c in ("low", "high")]
    q = save(q.groupBy("level", "lang", "source").agg(F.max("docs").alias("docs"), *[pick(k, c) for k in RATIOS for c in ("low", "high")]),
             "levels")
    level = lambda n: q.where(F.col("level") == n).select(
        F.col("lang").alias("its_lang"), F.struct("docs", *names).alias(f"at_{n}"))
    return (q.where("level = 0").select("lang", "source", F.struct("docs", *names).alias("at_0"))
            .join(level(1), F.col("lang").eqNullSafe(F.col("its_lang")), "left").join(level(2).drop("its_lang"), F.lit(True), "left")
            .select("lang", "source", F.when(F.col("at_0.docs") >= min_docs, F.col("at_0"))
                    .when(F.col("at_1.docs") >= min_docs, F.col("at_1")).otherwise(F.col("at_2")).alias("at"))
            .select("lang", "source", *[f"at.{c}" for c in names]))


def apply_rules(docs: DataFrame, spread: int = 7, min_docs: int = 20, window: int = 8, min_words: int = 20,
                max_repeat_pct: int = 30) -> DataFrame:
    """The counts of every document, base_failed, and kept by base and adaptive rules."""
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    counted = save(text_counts(docs, window).withColumn("base_failed", failed), "counts")
    limits = save(bounds(sketches(counted.where("not base_failed")), spread, min_docs), "bounds")
    limits = limits.withColumnRenamed("lang", "b_lang").withColumnRenamed("source", "b_source")
    joined = counted.join(limits, F.col("lang").eqNullSafe(F.col("b_lang")) & F.col("source").eqNullSafe(F.col("b_source")), "left")
    inside = F.lit(True)
    for k, (e, both, _) in RATIOS.items():
        inside = inside & (F.expr(e) <= F.col(f"{k}_high"))
        if both:
            inside = inside & (F.expr(e) >= F.col(f"{k}_low"))
    return joined.select("doc_id", "lang", "source", *COUNTS, "base_failed",
                         F.when(F.col("base_failed"), False).otherwise(F.coalesce(inside, F.lit(True))).alias("kept"))


def oracle_sql() -> str:
    """The result of :func:`apply_rules` with default parameters in DuckDB's SQL."""
    ratios = " UNION ALL ".join(
        f"SELECT lang, source, '{k}' AS ratio, {m} AS margin, CAST({e.replace(' div ', ' // ')} AS BIGINT) AS v FROM c WHERE NOT base_failed"
        for k, (e, _, m) in RATIOS.items())
    tests = " AND ".join(f"c.{k} <= b.{k}_high" + (f" AND c.{k} >= b.{k}_low" if both else "") for k, (_, both, _) in RATIOS.items())
    values = ", ".join(f"CASE WHEN NOT base_failed THEN {e.replace(' div ', ' // ')} END AS {k}" for k, (e, _, _) in RATIOS.items())
    picks = ", ".join(f"max(CASE WHEN ratio = '{k}' THEN low END) AS {k}_low, max(CASE WHEN ratio = '{k}' THEN high END) AS {k}_high" for k in RATIOS)
    chosen = ", ".join(f"CASE WHEN g.docs >= 20 THEN g.{x} WHEN y.docs >= 20 THEN y.{x} ELSE z.{x} END AS {x}"
                       for k in RATIOS for x in (f"{k}_low", f"{k}_high"))
    return rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[ \t-\r]+'), lambda x: x <> '') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS lines FROM t),
pos AS (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8),
win AS (SELECT rid, i, array_to_string(words[i:i + 7], ' ') AS x FROM pos),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, x) AS n FROM win) WHERE n > 1),
rep AS (SELECT rid, sum(least(8, coalesce(nxt - i, 8))) AS n FROM
        (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM dup) GROUP BY rid),
base AS (SELECT w.rid, doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words,
        CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines
        FROM w LEFT JOIN rep ON w.rid = rep.rid),
c AS (SELECT *, {values} FROM (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM base)),
r AS ({ratios}),
k AS (SELECT lang, source, ratio, margin, (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) AS value, count(*) AS n
      FROM r GROUP BY ALL),
lv AS (SELECT 0 AS level, lang, source, ratio, margin, value, n FROM k
       UNION ALL SELECT 1, lang, NULL, ratio, margin, value, sum(n) FROM k GROUP BY lang, ratio, margin, value
       UNION ALL SELECT 2, NULL, NULL, ratio, margin, value, sum(n) FROM k GROUP BY ratio, margin, value),
u AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, ratio ORDER BY value) AS upto,
        sum(n) OVER (PARTITION BY level, lang, source, ratio) AS total FROM lv),
m AS (SELECT *, min(CASE WHEN 2 * upto >= total THEN value END) OVER (PARTITION BY level, lang, source, ratio) AS mid FROM u),
f AS (SELECT *, abs(value - mid) AS far, sum(n) OVER (PARTITION BY level, lang, source, ratio ORDER BY abs(value - mid)) AS near FROM m),
q AS (SELECT level, lang, source, ratio, margin, mid, total, min(CASE WHEN 2 * near >= total THEN far END) AS far FROM f GROUP BY ALL),
e AS (SELECT level, lang, source, ratio, total, mid - greatest(7 * far, margin) AS low, mid + mid // 32 + greatest(7 * far, margin) AS high FROM q),
l AS (SELECT level, lang, source, max(total) AS docs, {picks} FROM e GROUP BY level, lang, source),
b AS (SELECT g.lang, g.source, {chosen} FROM (SELECT * FROM l WHERE level = 0) g
      LEFT JOIN (SELECT * FROM l WHERE level = 1) y ON g.lang IS NOT DISTINCT FROM y.lang
      LEFT JOIN (SELECT * FROM l WHERE level = 2) z ON true)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       CASE WHEN base_failed THEN false ELSE coalesce({tests}, true) END AS kept
FROM c LEFT JOIN b ON c.lang IS NOT DISTINCT FROM b.lang AND c.source IS NOT DISTINCT FROM b.source
"""
