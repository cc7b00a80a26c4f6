"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits are cut into segments; two that differ in at most
``max_distance`` bits differ in at most ``max_distance // segments`` bits of
some segment. The anchors of a segment are the words of a covering code:
products of the perfect binary Golay code of 23 bits (covering radius 3) and of
the bits that remain, taken as they are. A fingerprint has one home anchor in
each segment, within the covering radius, and is replicated to every anchor
within that radius plus the segment's share of the distance. So each linked
pair meets at the home of either one, and is compared there bit by bit.

An anchor's points are told apart further by the bytes of the other segment,
one of which is equal in a linked pair, lest chance meetings grow with the
square of the points.

Equal fingerprints are one point, so copies never meet as pairs. Keyed points
go to buckets; a task sorts one bucket and reduces the links of each group to a
spanning forest before they leave it. Groups of very many points are cut into
tiles, and each pair of tiles is a group of its own. Components are joined over
all anchors afterwards.

Cases: null or empty text has fingerprint 0 and links like any other; fewer
words than a shingle count as one shingle; null doc_ids are kept with a null
component; repeated rows and ids are kept; empty tables give empty results;
further columns are ignored; texts of any length are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, drop, mix64, pack_arrays, save, shuffle_partitions, text_blocks, unpack_arrays
from .components import connected_components

LOWER = bytes(range(256)).lower()
#: Generator polynomial of the perfect Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GOLAY = 0b101011100011
#: Points an anchor compares in one group; larger anchors are cut into tiles of this size.
TILE = 4096
#: Pairs up to which groups are compared many at once.
SMALL = 1024
#: Keyed points that a bucket holds at most, about; more points make more buckets.
BUCKET_ROWS = 1_000_000
#: Points of a file of the table of points.
FILE_POINTS = 100_000
#: Points whose anchors a task holds at a time.
CHUNK = 4096

KEYED = "bucket int, n int, body binary"
KEYED_ARROW = pa.schema([("bucket", pa.int32()), ("n", pa.int32()), ("body", pa.binary())])
LINKS = "a long, b long, key long, print long, node long, home boolean"
LINKS_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("print", pa.int64()),
                         ("node", pa.int64()), ("home", pa.bool_())])


def fingerprint(text: bytes, shingle: int) -> int:
    """Majority bits of the XXH64 (seed 42) of the text's word shingles."""
    import xxhash

    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    k = min(shingle, len(words))
    start = np.append(0, ends[:-1])[:len(words) - k + 1].tolist()
    end = (ends[k - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], 42) for a, b in zip(start, end)), np.uint64, len(start))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[at:at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int, *keep: str) -> DataFrame:
    """doc_id and print: the fingerprint's 64 bits as a signed long; and the columns named in ``keep``."""
    d = documents(docs, *keep)
    names = ["doc_id", "print", *keep]

    def run(batches):
        for rows, data, offs in text_blocks(batches):
            raw = data.tobytes()
            prints = [fingerprint(raw[a:b], shingle) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.array(prints, np.uint64).view(np.int64)),
                                              *(rows.column(2 + k) for k in range(len(keep)))], names=names)

    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields[2:]]
    return d.mapInArrow(run, ", ".join(["doc_id long", "print long", *types]))


class GolayCode:
    """Nearest word, and the words within radius 4, of vectors of 23 bits."""

    def __init__(self):
        words = np.zeros(1, np.int64)
        for k in range(12):
            words = np.concatenate([words, words ^ (GOLAY << k)])
        parity = np.array([self._syndrome(1 << i) for i in range(23)])
        self.parity = parity
        self.leader = np.zeros(1 << 11, np.int64)  # the error of weight 3 or less of each syndrome
        bits = range(23)
        for error in ([0], *([1 << i] for i in bits), *([1 << i, 1 << j] for i in bits for j in range(i)),
                      *([1 << i, 1 << j, 1 << k] for i in bits for j in range(i) for k in range(j))):
            e = int(np.bitwise_or.reduce(error))
            self.leader[self._syndrome(e)] = e
        # Differences between a vector's own word and others within 4 bits, by the error's leader.
        weight = np.array([int(w).bit_count() for w in words])
        near = words[(weight == 7) | (weight == 0)]
        self.near = {int(e): near[[int(w ^ e).bit_count() <= 4 for w in near]] for e in self.leader}

    @staticmethod
    def _syndrome(v: int) -> int:
        for i in range(22, 10, -1):
            if v >> i & 1:
                v ^= GOLAY << (i - 11)
        return v

    def errors(self, v: np.ndarray) -> np.ndarray:
        s = np.zeros(len(v), np.int64)
        for i in range(23):
            s ^= (v >> i & 1) * self.parity[i]
        return self.leader[s]


def anchors(prints: np.ndarray, code: GolayCode) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For both 32-bit segments: (point, segment, anchor, whether it is home) of
    every anchor within the covering radius plus one bit."""
    out = []
    for segment in range(2):
        part = (prints >> np.uint64(32 * segment) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        low, high = part & 0x7FFFFF, part >> 23
        error = code.errors(low)
        own = low ^ error
        points = np.arange(len(prints))
        # One bit of the nine plain ones differs: the same word, nine neighbours.
        for bit in range(9):
            out.append((points, segment, own | (high ^ (1 << bit)) << 23, False))
        # One bit of the 23 differs: the words within radius 4, the nearest of them home.
        order = np.argsort(error, kind="stable")
        cuts = np.flatnonzero(np.diff(error[order])) + 1
        for group in np.split(order, cuts):
            if len(group):
                for w in code.near[int(error[group[0]])]:
                    out.append((group, segment, (own[group] ^ w) | high[group] << 23, w == 0))
    size = [len(p) for p, _, _, _ in out]
    return (np.concatenate([p for p, _, _, _ in out]), np.repeat([s for _, s, _, _ in out], size),
            np.concatenate([a for _, _, a, _ in out]), np.repeat([h for _, _, _, h in out], size))


class Forest:
    """Spanning forest of the links one task finds; each link joins two trees."""

    def __init__(self):
        self.parent: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        while (up := self.parent.setdefault(x, x)) != x:
            self.parent[x] = self.parent[up]
            x = up
        return x

    def join(self, pairs) -> None:
        for x, y in pairs:
            a, b = self.root(x), self.root(y)
            if a != b:
                self.parent[max(a, b)] = min(a, b)
                self.links.append((x, y))


def keyed(prints: np.ndarray, code: GolayCode) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(point, key, whether it is home): the anchors of each point, each once with
    every byte of the other segment. That one differs in at most three bits, so
    one of its four bytes is equal: a finer key with fewer chance meetings."""
    who, segment, anchor, home = anchors(prints, code)
    other = (prints[who] >> (32 * (1 - segment)).astype(np.uint64)) & np.uint64(0xFFFFFFFF)
    base = segment.astype(np.uint64) << np.uint64(42) | anchor.astype(np.uint64) << np.uint64(8)
    keys = [base | np.uint64(j) << np.uint64(40) | (other >> np.uint64(8 * j)) & np.uint64(0xFF) for j in range(4)]
    return np.tile(who, 4), np.concatenate(keys), np.tile(home, 4)


def compare_small(prints: np.ndarray, nodes: np.ndarray, homes: np.ndarray, h_n: np.ndarray, h_off: np.ndarray,
                  g_n: np.ndarray, g_off: np.ndarray, most: int, forest: Forest) -> None:
    """Links between the homes (``homes[h_off:h_off + h_n]``) and all points
    (``g_off:g_off + g_n``) of many small groups at once."""
    size = h_n * g_n
    k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    width = np.repeat(g_n, size)
    i, j = homes[np.repeat(h_off, size) + k // width], np.repeat(g_off, size) + k % width
    near = np.flatnonzero((np.bitwise_count(prints[i] ^ prints[j]) <= most) & (prints[i] != prints[j]))
    forest.join(zip(nodes[i[near]].tolist(), nodes[j[near]].tolist()))


def compare_large(home: np.ndarray, home_node: np.ndarray, guest: np.ndarray, guest_node: np.ndarray, most: int,
                  forest: Forest) -> None:
    """Links of one large group: a row of distances a home, trees kept as labels."""
    prints, first = np.unique(np.concatenate([home, guest]), return_index=True)
    node = np.concatenate([home_node, guest_node])[first]
    label = np.arange(len(prints))
    column = np.searchsorted(prints, guest)
    for p, row in zip(home, np.searchsorted(prints, home)):
        near = column[np.bitwise_count(guest ^ p) <= most]
        trees = np.unique(np.append(label[near], label[row]))
        if len(trees) > 1:
            label[np.isin(label, trees)] = trees[0]
            forest.join((int(node[trees[0]]), int(node[t])) for t in trees[1:])


def tiled(members: DataFrame, most: int) -> DataFrame:
    """Links (a, b) within groups of very many points: a group (key) is cut into
    tiles by a hash, and the homes of one tile meet the points of another in a
    group of their own."""
    sizes = members.groupBy("key").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    placed = members.join(sizes, "key").withColumn("tile", F.pmod(F.xxhash64("print"), F.col("tiles")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    homes = placed.where("home").withColumn("other", others)
    guests = placed.withColumnRenamed("tile", "other").withColumn("tile", others).withColumn("home", F.lit(False))
    columns = ["key", "tile", "other", "home", "print", "node"]
    groups = homes.select(columns).unionAll(guests.select(columns)).groupBy("key", "tile", "other").agg(
        F.collect_list(F.when(F.col("home"), F.struct("print", "node"))).alias("homes"),
        F.collect_list(F.when(~F.col("home"), F.struct("print", "node"))).alias("guests")).where("size(homes) > 0")

    def compare(batches):
        for b in batches:
            forest = Forest()
            for homes_, guests_ in zip(b.column(0), b.column(1)):
                h, g = homes_.values, guests_.values
                compare_large(h.field("print").to_numpy().view(np.uint64), h.field("node").to_numpy(),
                              g.field("print").to_numpy().view(np.uint64), g.field("node").to_numpy(), most, forest)
            yield pa.record_batch([pa.array([x for x, _ in forest.links], pa.int64()),
                                   pa.array([y for _, y in forest.links], pa.int64())], names=["a", "b"])

    return groups.select("homes", "guests").mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_distance: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document.
    Documents are their doc_ids: one that several rows share links what they link."""
    found = _linked(docs, shingle, max_distance, (), by_text=False)
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
                        F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))


def near_groups(docs: DataFrame, shingle: int, max_distance: int, *keep: str) -> DataFrame:
    """doc_id, print, the columns named in ``keep``, and group of every row: texts
    are linked by themselves, whatever their doc_ids, and a group has the name of
    its smallest print. Rows without doc_id have no group."""
    found = _linked(docs, shingle, max_distance, keep, by_text=True)
    return found.select("doc_id", "print", *keep, F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("group"))


def _linked(docs: DataFrame, shingle: int, max_distance: int, keep: tuple, by_text: bool) -> DataFrame:
    """doc_id, print, ``keep`` and component of every row. Points, one for each
    print, are named by their print or by their smallest doc_id."""
    if not 0 <= max_distance <= 3:
        raise ValueError("two segments with one differing bit each cover distances up to 3")
    spark = docs.sparkSession
    prints = save(fingerprints(docs, shingle, *keep), "prints")
    points = prints.where("doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("node"))
    points = points.withColumn("node", F.col("print")) if by_text else points
    points = save(points.coalesce(1 + prints.count() // FILE_POINTS), "points")
    buckets = max(4 * shuffle_partitions(spark), points.count() * 115 // BUCKET_ROWS)

    def replicate(batches):
        code = GolayCode()
        for b in batches:
            p, node = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()
            for a in range(0, len(p), CHUNK):
                who, key, home = keyed(p[a:a + CHUNK], code)
                bucket = (mix64(key) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                who, key, home = who[order] + a, key[order], home[order].astype(np.uint8)
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                used = np.flatnonzero(np.diff(cuts))
                body = [pack_arrays(key[x:y], p[who[x:y]], node[who[x:y]], home[x:y]) for x, y in zip(cuts[used], cuts[used + 1])]
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(np.diff(cuts)[used], pa.int32()),
                                                  pa.array(body, pa.binary())], schema=KEYED_ARROW)

    def compare(t: pa.Table) -> pa.Table:
        parts = [unpack_arrays(x.as_py(), n, np.uint64, np.uint64, np.int64, np.uint8)
                 for x, n in zip(t.column("body"), t.column("n").to_pylist())]
        key, print_, node, home = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(key, kind="stable")
        key, print_, node, home = key[order], print_[order], node[order], home[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        n = np.diff(np.append(first, len(key)))
        homes = np.flatnonzero(home)
        h_first = np.searchsorted(homes, first)
        h_n = np.diff(np.append(h_first, len(homes)))
        met = (n > 1) & (h_n > 0)
        forest, large = Forest(), np.flatnonzero(met & (n > TILE))
        small = np.flatnonzero(met & (n * h_n <= SMALL))
        compare_small(print_, node, homes, h_n[small], h_first[small], n[small], first[small], max_distance, forest)
        for k in np.flatnonzero(met & (n * h_n > SMALL) & (n <= TILE)):
            g, h = slice(first[k], first[k] + n[k]), homes[h_first[k]:h_first[k] + h_n[k]]
            compare_large(print_[h], node[h], print_[g], node[g], max_distance, forest)
        rest = np.concatenate([np.arange(first[k], first[k] + n[k]) for k in large]) if len(large) else np.zeros(0, np.int64)
        nothing = pa.nulls(len(forest.links), pa.int64())
        links = pa.table([pa.array([x for x, _ in forest.links], pa.int64()), pa.array([y for _, y in forest.links], pa.int64()),
                          nothing, nothing, nothing, pa.nulls(len(forest.links), pa.bool_())], schema=LINKS_ARROW)
        left = pa.table([pa.nulls(len(rest), pa.int64()), pa.nulls(len(rest), pa.int64()), pa.array(key[rest].view(np.int64)),
                         pa.array(print_[rest].view(np.int64)), pa.array(node[rest]), pa.array(home[rest].astype(bool))], schema=LINKS_ARROW)
        return pa.concat_tables([links, left])

    found = save(points.mapInArrow(replicate, KEYED).groupBy("bucket").applyInArrow(lambda t: compare(t), LINKS), "links")
    edges = found.where("a is not null").select("a", "b")
    large = found.where("key is not null").drop("a", "b")
    if not large.isEmpty():
        edges = edges.unionAll(save(tiled(large, max_distance), "links-large"))
    components = connected_components(edges)
    drop(found)
    labelled = points.join(components, points["node"] == components["node"], "left").select(
        "print", F.coalesce("component", points["node"]).alias("component"))
    return prints.join(labelled, "print", "left").select("doc_id", "print", *keep, "component")
