"""Audit of how far the sources of a language differ in their words.

Terms are counted once per document group (language and source); a language
keeps the terms that enough of its documents hold. Each group's counts of kept
terms are laid out as sorted (term id, count) arrays, cut into shards by term id
so that no task holds a whole vocabulary. For every unordered pair of a
language's sources the two sides' arrays are brought together shard by shard
and merged by galloping search: terms of both, of one side alone, and (by their
number only) of neither are priced as differences of the smoothed shares, and
the sums count both ways. A second report names the terms that are most over
their share in the language.

Every share is an integer, 1 + floor(scale * (count + prior) / (N + prior * V)),
found without rounding: long division in base 1000 in numpy, decimals in SQL.

Cases: null text, lang and source are empty strings; a document without terms
still makes its group occur; repeated rows and ids count each; a language
without kept terms has distances of 0; a language with one source has no pairs;
empty tables give empty results; further columns are ignored; long texts are
counted in slices, cut between terms.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, pack_arrays, save, string_array, text_slices, unpack_arrays, word_spans

SLICE_BYTES = 4 << 20
#: Terms of a shard: what a task holds of one group's vocabulary.
SHARD_TERMS = 1 << 14
SCALE, PRIOR = 1_000_000_000, 5

COUNTS = "lang string, source string, term string, n long, docs long"
COUNTS_ARROW = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
ARRAYS = "lang string, source string, shard long, n int, body binary"
ARRAYS_ARROW = pa.schema([("lang", pa.string()), ("source", pa.string()), ("shard", pa.int64()), ("n", pa.int32()), ("body", pa.binary())])
PARTIAL = "lang string, a string, b string, held long, value long"
PARTIAL_ARROW = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("held", pa.int64()), ("value", pa.int64())])

#: Bytes outside terms: all ASCII but letters.
_OUTSIDE = np.ones(256, bool)
_OUTSIDE[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def count_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it); and a
    row without term for each group that occurs."""

    def run(batches):
        seen: set[str] = set()  # terms of the long text that is being read
        for rows, data, offs, first, last in text_slices(batches, SLICE_BYTES, lambda before, at: _OUTSIDE[at]):
            low = _LOWER[data]
            start, end = word_spans(low, offs, _OUTSIDE)
            doc = np.searchsorted(offs, start, "right") - 1
            groups = pa.StructArray.from_arrays([rows.column(k).cast(pa.string()) for k in (2, 3)], ["lang", "source"])
            # Structs can't be dictionary-encoded: number the pairs of both columns' codes.
            codes = [groups.field(k).dictionary_encode() for k in (0, 1)]
            pair = codes[0].indices.to_numpy().astype(np.int64) * max(1, len(codes[1].dictionary)) + codes[1].indices.to_numpy()
            pairs, one, group = np.unique(pair, return_index=True, return_inverse=True)
            terms = string_array(low, start, end).cast(pa.string()).dictionary_encode()
            width = max(1, len(terms.dictionary))
            code = terms.indices.to_numpy().astype(np.int64)
            key, n = np.unique(group[doc] * width + code, return_counts=True)
            held = np.unique(doc * width + code)
            key_of_doc = group[held // width] * width + held % width
            in_docs = np.bincount(np.searchsorted(key, key_of_doc), minlength=len(key))
            if not (first and last):  # one text: a term counts a document when it is first met
                new = np.array([t not in seen for t in terms.dictionary.to_pylist()], bool)
                in_docs = new[key % width].astype(np.int64)
                seen = set() if last else seen.union(terms.dictionary.to_pylist())
            at = pa.array(one[key // width])
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([groups.field(0).take(at), groups.field(0).take(pa.array(one))]),
                 pa.concat_arrays([groups.field(1).take(at), groups.field(1).take(pa.array(one))]),
                 pa.concat_arrays([terms.dictionary.take(pa.array(key % width)), pa.nulls(len(one), pa.string())]),
                 pa.array(np.append(n, np.zeros(len(one), np.int64)), pa.int64()),
                 pa.array(np.append(in_docs, np.zeros(len(one), np.int64)), pa.int64())], schema=COUNTS_ARROW)

    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return (docs.select(F.lit(0).alias("row"), blank("text"), blank("lang"), blank("source")).mapInArrow(run, COUNTS)
            .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def shares(count: np.ndarray, total: int, kept: int) -> np.ndarray:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * kept)), exactly."""
    under = total + PRIOR * kept
    rest = count.astype(np.int64) + PRIOR
    if under >= 1 << 53:  # a digit of the long division might pass 64 bits
        return np.array([1 + SCALE * int(x) // under for x in rest.tolist()], np.int64)
    out, rest = rest // under, rest % under
    for _ in range(3):
        rest *= 1000
        out = out * 1000 + rest // under
        rest %= under
    return 1 + out


def gallop(have: np.ndarray, want: np.ndarray, run: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``have`` and ``want`` (both sorted) of the values they share.

    ``want``, the shorter one, is taken in runs; for each, the window in ``have``
    is found by doubling steps from where the last one ended, and searched."""
    places, of, at = [], [], 0
    for k in range(0, len(want), run):
        part = want[k:k + run]
        at += int(np.searchsorted(have[at:at + 1], part[0]))
        step = run
        while at + step < len(have) and have[at + step] <= part[-1]:
            step *= 2
        window = have[at:at + step + 1]
        found = np.searchsorted(window, part)
        hit = found < len(window)
        hit[hit] = window[found[hit]] == part[hit]
        places.append(at + found[hit])
        of.append(k + np.flatnonzero(hit))
        at = min(at + int(found[-1]), len(have))
    none = np.zeros(0, np.int64)
    return (np.concatenate(places), np.concatenate(of)) if places else (none, none)


def price(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], totals: tuple[int, int], kept: int) -> tuple[int, int]:
    """How many terms either side holds, and the sum of the differences of their shares."""
    if len(a[0]) < len(b[0]):
        a, b, totals = b, a, totals[::-1]
    in_a, in_b = gallop(a[0], b[0])
    mine, theirs = shares(a[1], totals[0], kept), shares(b[1], totals[1], kept)
    none_a, none_b = (int(shares(np.zeros(1, np.int64), t, kept)[0]) for t in totals)
    alone_a, alone_b = np.ones(len(a[0]), bool), np.ones(len(b[0]), bool)
    alone_a[in_a] = alone_b[in_b] = False
    value = sum(int(np.abs(x).sum()) for x in (mine[in_a] - theirs[in_b], mine[alone_a] - none_b, theirs[alone_b] - none_a))
    return len(a[0]) + len(b[0]) - len(in_a), value


def audit(docs: DataFrame, min_docs: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: distances between the sources of a
    language (part 'pair', all), and each source's terms that are most above
    their share in the language (part 'term', the first ``top``)."""
    spark = docs.sparkSession
    counts = save(count_terms(docs), "terms")
    of_lang = (counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
               .where(F.col("docs") >= min_docs).drop("docs"))
    kept = save(of_lang.withColumn("id", F.monotonically_increasing_id()), "kept")  # written once, so an id stays as it is
    lang_totals = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    used = save(counts.where("term is not null").select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "used")
    groups = (counts.where("term is null").select("lang", "source").distinct()
              .join(used.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
              .join(lang_totals, "lang", "left").fillna(0, ["total", "kept", "lang_total"]))
    groups = save(groups, "groups")
    drop(counts)

    # Terms are dealt to shards by a hash of their id, SHARD_TERMS to each, about.
    terms = groups.agg(F.max("kept")).first()[0] or 0
    shards = max(1, -(-int(terms) // SHARD_TERMS))

    def lay_out(t: pa.Table) -> pa.Table:
        ids, n = t.column("id").to_numpy(), t.column("n").to_numpy()
        order = np.argsort(ids)
        return pa.table([t.column("lang")[:1].combine_chunks(), t.column("source")[:1].combine_chunks(), t.column("shard")[:1].combine_chunks(),
                         pa.array([len(ids)], pa.int32()), pa.array([pack_arrays(np.diff(ids[order], prepend=0), n[order])], pa.binary())],
                        schema=ARRAYS_ARROW)

    arrays = save(used.select("lang", "source", "id", "n", F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"))
                  .groupBy("lang", "source", "shard").applyInArrow(lambda t: lay_out(t), ARRAYS), "arrays")

    side = lambda s: groups.select("lang", F.col("source").alias(s), F.col("total").alias(f"total_{s}"), "kept")
    pairs = save(side("a").join(side("b").drop("kept"), "lang").where("a < b"), "pairs")  # the report's rows, halved
    again = lambda df: spark.read.schema(df.schema).parquet(df.shared_path)  # noqa: E731  with columns of its own

    def merge(left: pa.Table, right: pa.Table) -> pa.Table:
        some = left if left.num_rows else right
        of = {c: some.column(c)[0].as_py() for c in ("lang", "a", "b", "total_a", "total_b", "kept")}
        sides = []
        for t in (left, right):
            body, n = (t.column("body")[0].as_py(), t.column("n")[0].as_py()) if t.num_rows else (b"", 0)
            step, count = unpack_arrays(body, n, np.int64, np.int64)
            sides.append((np.cumsum(step), count))
        held, value = price(*sides, (of["total_a"], of["total_b"]), of["kept"])
        return pa.table([[of["lang"]], [of["a"]], [of["b"]], [held], [value]], schema=PARTIAL_ARROW)

    left, right = (again(pairs).join(again(arrays).withColumnRenamed("source", s), ["lang", s]) for s in ("a", "b"))
    partial = (left.groupBy("lang", "a", "b", "shard").cogroup(right.groupBy("lang", "a", "b", "shard"))
               .applyInArrow(lambda x, y: merge(x, y), PARTIAL)
               .groupBy("lang", "a", "b").agg(F.sum("held").alias("held"), F.sum("value").alias("value")))
    absent = lambda s: F.expr(f"{SCALE * PRIOR}L div (total_{s} + {PRIOR}L * kept)")
    value = F.coalesce("value", F.lit(0)) + (F.col("kept") - F.coalesce("held", F.lit(0))) * F.abs(absent("a") - absent("b"))
    priced = pairs.join(partial, ["lang", "a", "b"], "left").select("lang", "a", "b", F.when(F.col("kept") == 0, 0).otherwise(value).cast("long").alias("value"))
    both = priced.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                                                   F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "value")
    both = both.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")

    exact = lambda n, total: (f"1 + ((cast({n} as decimal(20,0)) + {PRIOR}) * cast({SCALE} as decimal(10,0)))"  # noqa: E731
                              f" div (cast({total} as decimal(20,0)) + {PRIOR}L * kept)")
    over = (used.join(groups, ["lang", "source"]).withColumn("value", F.expr(f"{exact('n', 'total')} - ({exact('lang_n', 'lang_total')})"))
            .where("n > 0 and value > 0").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    ranked = over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return both.withColumn("rank", F.row_number().over(order)).unionByName(ranked)


def oracle_sql(min_docs: int = 30, top: int = 50) -> str:
    """The same for DuckDB."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    share = lambda n, total: f"1 + ({SCALE}::HUGEINT * ({n} + {PRIOR})) // ({total} + {PRIOR} * kept)"
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
       regexp_extract_all({lower}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
occurrences AS (SELECT row_id, lang, source, unnest(terms) AS term FROM docs),
counts AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM occurrences GROUP BY ALL),
kept_terms AS (SELECT lang, term, count(*)::HUGEINT AS lang_n FROM occurrences GROUP BY ALL HAVING count(DISTINCT row_id) >= {min_docs}),
langs AS (SELECT lang, count(*)::HUGEINT AS kept, sum(lang_n)::HUGEINT AS lang_total FROM kept_terms GROUP BY lang),
used AS (SELECT lang, source, term, n, lang_n FROM counts JOIN kept_terms USING (lang, term)),
totals AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM used GROUP BY ALL),
groups AS (SELECT lang, source, coalesce(total, 0) AS total, coalesce(kept, 0) AS kept, coalesce(lang_total, 0) AS lang_total
       FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN totals USING (lang, source) LEFT JOIN langs USING (lang)),
grid AS (SELECT g.lang, g.source, k.term, {share("coalesce(n, 0)", "total")} AS p
       FROM groups g JOIN kept_terms k USING (lang) LEFT JOIN used USING (lang, source, term)),
priced AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
       FROM grid x JOIN grid y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
       FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
       LEFT JOIN priced ON priced.lang = a.lang AND priced.source = a.source AND priced.item = b.source),
over_share AS (SELECT lang, source, 'term' AS part, term AS item, {share("n", "total")} - ({share("lang_n", "lang_total")}) AS value
       FROM used JOIN groups USING (lang, source))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM over_share WHERE value > 0))
WHERE part = 'pair' OR rank <= {top}"""
