"""Connected components of an edge table, by repeated joins and aggregates."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, save

#: Rows of a file of the tables between rounds.
FILE_ROWS = 200_000


def contracted(pairs: DataFrame, files: int) -> DataFrame:
    """The same components with fewer steps to go: each of ``files`` parts of the
    table, about FILE_ROWS rows, is replaced by stars around its smallest nodes."""

    def contract(batches):
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = parent[up]
                x = up
            return x

        for b in batches:
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                u, v = root(u), root(v)
                parent[max(u, v)] = min(u, v)
        stars = [(x, r) for x in list(parent) if (r := root(x)) != x]
        yield pa.record_batch([pa.array([x for x, _ in stars], pa.int64()), pa.array([r for _, r in stars], pa.int64())], names=["u", "v"])

    return pairs.select("u", "v").coalesce(files).mapInArrow(contract, "u long, v long")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b: long); component is the
    smallest node that can be reached. Null ends are ignored.

    Large-star and small-star rounds: every node links its larger neighbours,
    then its smaller ones, to the smallest of them, until the table is a forest
    of stars. A round costs one aggregate and one join on the node; the hot
    centre of a star is aggregated before the shuffle (min), and joined to its
    neighbours by a join whose skewed partitions AQE splits. Each round is
    written to the shared folder, in as few files as its rows need, and the one
    before it dropped.
    """
    pairs = (edges.where("a is not null and b is not null and a <> b")
             .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    first = save(pairs, "cc")
    files = 1 + first.count() // FILE_ROWS  # no round has more rows than the first
    pairs = save(contracted(first, files), "cc")
    drop(first)
    while True:
        both = pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = save(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                     .where("u <> v").distinct().coalesce(files), "cc")
        # Small star: u > v holds; link all smaller neighbours and u itself to the smallest.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        links = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        small = large.join(least, "u").select(F.explode(links).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        small = save(contracted(small, files), "cc")
        summary = [F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")]
        before, after = pairs.agg(*summary).first(), small.agg(*summary).first()
        drop(large)
        drop(pairs)
        pairs = small
        if before == after:
            break
    return (pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionAll(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
