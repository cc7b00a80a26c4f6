"""Benchmark decontamination with a distributed positional inverted index.

Windows of benchmark words are looked up in the documents. First the frequency
of every benchmark term in the documents is counted. Each window is searched by
its rarest terms: the postings (term, document, position) of those terms alone
are stored, the ones of a window's rarest term with the words around them. The
lists of the two rarest terms, moved by their offsets in the window, are
intersected on (document, window, start); what remains is compared with the
stored words. A start where all words agree is an exact match, one where the
second term stands within ``slack`` words of its place a proximity match.

Rows of documents are told apart by doc_id and the hash of their text, so
repeated ids stay apart and repeated rows get the same result.

Cases: null texts and items have no words and match nothing; an item with fewer
words than a window is one window; empty tables give no matches; repeated items
with one id count once; further columns are ignored; texts of any length are
read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save

#: Characters between words. Words are lower-cased afterwards, so A-Z are none.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows up to which a table of benchmark terms or windows is broadcast; beyond, joins shuffle.
BROADCAST_ROWS = 200_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def lowered(word: Column) -> Column:
    """A-Z in lower case, and no other letter changed."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def _is_small(table: DataFrame) -> bool:
    return table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def _small(table: DataFrame) -> DataFrame:
    """The table, broadcast if its counted rows are within the bound."""
    return F.broadcast(table) if _is_small(table) else table


def windows_of(benchmark: DataFrame, size: int = 13) -> DataFrame:
    """item_id, win (hash of the words), words: each window of each item once."""
    item = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.transform(words_of(F.col("text")), lowered).alias("w"))
    item = item.where(F.col("item_id").isNotNull() & (F.size("w") > 0))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))
    each = item.select("item_id", "w", F.explode(starts).alias("s")).select("item_id", F.slice("w", F.col("s"), size).alias("words"))
    return each.distinct().withColumn("win", F.xxhash64("words"))


def _occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, th, pos, term of every word, beside all words ``w`` of its text."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), words_of(F.col("text")).alias("w"))
    return d.select("doc_id", "th", "w", F.posexplode("w").alias("pos", "raw")).withColumn("term", lowered(F.col("raw")))


def term_counts(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """How often each benchmark term occurs in the documents (absent ones: no row)."""
    terms = save(windows.select(F.explode("words").alias("term")).distinct(), "terms")
    return save(_occurrences(docs).join(_small(terms), "term").groupBy("term").agg(F.count("*").alias("n")), "term-counts")


def plan(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """For each window with all terms present: its words, and term and offset of
    the rarest (term1, off1) and of the next rarest other term (term2, off2; null
    if it has one term only). Ties go to the smaller term, then the first place."""
    distinct = windows.select("win", "words").distinct()
    each = distinct.select("win", "words", F.posexplode("words").alias("off", "term"))
    known = each.join(_small(counts), "term")
    order = F.array_sort(F.collect_list(F.struct("n", "term", "off")))
    by = known.groupBy("win", "words").agg(order.alias("o")).where(F.size("o") == F.size("words"))
    other = F.filter("o", lambda x: x["term"] != F.col("o")[0]["term"])
    return by.select("win", "words", F.col("o")[0]["term"].alias("term1"), F.col("o")[0]["off"].alias("off1"),
                     F.get(other, F.lit(0))["term"].alias("term2"), F.get(other, F.lit(0))["off"].alias("off2"))


def index(docs: DataFrame, searches: DataFrame, size: int = 13) -> DataFrame:
    """The stored index: doc_id, th, term, pos, and for rarest terms the words
    from ``size - 1`` before to ``size - 1`` behind (``first``: where they begin)."""
    terms = searches.select(F.col("term1").alias("term"), F.lit(True).alias("rarest")).unionAll(
        searches.where("term2 is not null").select("term2", F.lit(False))).groupBy("term").agg(F.max("rarest").alias("rarest"))
    terms = save(terms, "rarest")
    first = F.greatest(F.col("pos") - (size - 1), F.lit(0))
    around = F.slice("w", F.col("first") + 1, F.col("pos") - F.col("first") + size)
    each = _occurrences(docs).withColumn("first", first)
    if _is_small(terms):
        found = each.join(F.broadcast(terms), "term").withColumn("around", around)
    else:  # the join shuffles: rows must not carry their whole text
        found = each.withColumn("around", around).drop("w").join(terms, "term")
    return save(found.select("doc_id", "th", "term", "pos", "rarest", "first",
                             F.when(F.col("rarest"), F.transform("around", lowered)).alias("around")), "postings")


def matches(docs: DataFrame, benchmark: DataFrame, size: int = 13, slack: int = 2) -> tuple[DataFrame, DataFrame]:
    """(windows of the items, matches): a match has doc_id, th, win, start, n (its
    words) and exact (all words agree; else a proximity match)."""
    windows = save(windows_of(benchmark, size), "windows")
    searches = save(plan(windows, term_counts(docs, windows)), "searches")
    postings = index(docs, searches, size)
    small = _small(searches)
    anchor = (postings.where("rarest").join(small.withColumnRenamed("term1", "term"), "term")
              .withColumn("start", F.col("pos") - F.col("off1")))
    n = F.size("words")
    same = (F.col("start") >= F.col("first")) & (F.slice("around", F.greatest(F.col("start") - F.col("first") + 1, F.lit(1)), n) == F.col("words"))
    anchor = anchor.select("doc_id", "th", "win", "start", n.alias("n"), F.col("term2").isNull().alias("single"), same.alias("exact"))
    second = (postings.join(_small(searches.where("term2 is not null").select(F.col("win").alias("w2"), F.col("term2").alias("term"), "off2")), "term")
              .select(F.col("doc_id").alias("d2"), F.col("th").alias("t2"), "w2", (F.col("pos") - F.col("off2")).alias("start2")))
    # starts within the slack lie in one stretch of 2 * slack + 1 or in two beside each other
    stretch = lambda start: F.floor(start / (2 * slack + 1)).cast("long")
    second = second.withColumn("s2", stretch(F.col("start2"))).distinct()
    both = F.array_distinct(F.array(stretch(F.col("start") - slack), stretch(F.col("start") + slack)))
    met = (anchor.where("not single").withColumn("stretch", F.explode(both)).join(second, [
        F.col("doc_id").eqNullSafe(F.col("d2")), F.col("th") == F.col("t2"), F.col("win") == F.col("w2"), F.col("stretch") == F.col("s2"),
        F.abs(F.col("start") - F.col("start2")) <= slack], "left_semi").drop("stretch").distinct())
    return windows, met.unionAll(anchor.where("single and exact")).drop("single")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 13, share: int = 20, slack: int = 2) -> DataFrame:
    """Per document: n_words, n_hit (words in exact matches), n_items, items
    (sorted ids, comma-joined), contaminated (some hit, at least 1 word in
    ``share``), and n_near (proximity matches that aren't exact)."""
    windows, found = matches(docs, benchmark, size, slack)
    found = save(found.select("doc_id", "th", "win", "start", "n", "exact").distinct(), "matches")
    exact = found.where("exact").drop("exact")
    near = found.where("not exact").groupBy(F.col("doc_id").alias("d3"), F.col("th").alias("t3")).agg(F.count("*").alias("n_near"))
    spans = exact.select("doc_id", "th", "start", (F.col("start") + F.col("n")).alias("end")).distinct()
    order = Window.partitionBy("doc_id", "th").orderBy("start", "end")
    reached = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hit = (spans.withColumn("new", F.greatest(F.col("end") - F.greatest("start", reached), F.lit(0)))
           .groupBy("doc_id", "th").agg(F.sum("new").alias("n_hit")))
    items = (exact.select("doc_id", "th", "win").distinct().join(_small(windows.select("win", "item_id").distinct()), "win")
             .groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("item_id")).alias("items")))
    per = (hit.join(items.withColumnRenamed("doc_id", "d2").withColumnRenamed("th", "t2"),
                    F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("th") == F.col("t2")))
           .select(F.col("doc_id").alias("h_id"), F.col("th").alias("h_th"), "n_hit", "items"))
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"),
                        F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    return (every.join(per, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("th") == F.col("h_th")), "left")
            .join(near, F.col("doc_id").eqNullSafe(F.col("d3")) & (F.col("th") == F.col("t3")), "left")
            .select("doc_id", F.col("th").alias("text_hash"), "n_words", n_hit.alias("n_hit"),
                    F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
                    F.coalesce(F.array_join("items", ","), F.lit("")).alias("items"),
                    ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
                    F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near")))


def oracle_sql() -> str:
    """The query's result in DuckDB's SQL: every window joined by its text, and
    for proximity the places of each window's two rarest terms."""
    words = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '" + UPPER + "', '" + LOWER + r"'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {words} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, array_to_string(w[s:s + 12], ' ') AS x, least(len(w), 13) AS n
       FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT rid, s, n, array_to_string(w[s:s + n - 1], ' ') AS x
       FROM (SELECT d.*, sizes.n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT DISTINCT rid, s, n, x FROM dw SEMI JOIN iw USING (n, x)),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM hits) GROUP BY rid),
it AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items
       FROM hits JOIN iw USING (n, x) GROUP BY rid),
occ AS (SELECT rid, unnest(w) AS term, unnest(range(0, len(w))) AS p FROM d),
freq AS (SELECT term, count(*) AS c FROM occ SEMI JOIN (SELECT DISTINCT unnest(w) AS term FROM i) USING (term) GROUP BY term),
win AS (SELECT DISTINCT x, n, string_split(x, ' ') AS w FROM iw),
wt AS (SELECT x, n, unnest(w) AS term, unnest(range(0, len(w))) AS off FROM win),
wk AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY c, term, off) AS k, count(*) OVER (PARTITION BY x) AS have FROM wt JOIN freq USING (term)),
t1 AS (SELECT x, n, term, off FROM wk WHERE k = 1 AND have = n),
t2 AS (SELECT x, term, off FROM (SELECT wk.x, wk.term, wk.off, row_number() OVER (PARTITION BY wk.x ORDER BY wk.k) AS j
       FROM wk JOIN t1 ON wk.x = t1.x AND wk.term <> t1.term) WHERE j = 1),
one AS (SELECT rid, x, n, p - off AS s FROM t1 JOIN occ USING (term)),
two AS (SELECT DISTINCT rid, x, unnest(range(p - off - 2, p - off + 3)) AS s FROM t2 JOIN occ USING (term)),
nr AS (SELECT rid, count(*) AS n_near FROM (SELECT DISTINCT rid, x, s FROM one SEMI JOIN two USING (rid, x, s)) a
       WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.rid = a.rid AND h.x = a.x AND h.s = a.s + 1) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
       CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN pos ON d.rid = pos.rid LEFT JOIN it ON d.rid = it.rid LEFT JOIN nr ON d.rid = nr.rid
"""
