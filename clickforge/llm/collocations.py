"""Phrases of two to four words that stand together more often than their parts.

1. Texts are cut into pieces and words; each block keeps its distinct words once
   and its texts as places in that list. Words are counted per language, and
   those of at least ``least`` occurrences get dense ids, frequent words first.
   A phrase that occurs so often has no rarer word, so rarer words end a piece.
2. Ids come back to the blocks by a join. From the sorted word windows of a
   block (up to four words from each place) a count transducer is built for
   every prefix class: an acyclic automaton whose transitions carry a word and
   how often the path so far occurs. It is built from the last words to the
   first; states with the same transitions are merged as they are completed.
3. The automata of a prefix class are united with their weights summed. A class
   holds some first words; a first word too frequent for one task is dealt out
   further by its next two words, and the weights of its short paths, of which
   every part has some, are summed afterwards.
4. The united automaton of the frequent paths is composed with each candidate
   to look up its parts: a first part lies on the candidate's own path, a rest
   goes to the class of its first word and is composed with the automaton there.

Scores are floors of exact decimals. A phrase goes if a longer candidate holds
it and occurs nearly as often.

Cases: null text is empty, null lang is 'und' (one with documents of that name);
repeated rows count each; fewer than two words in a piece give no phrase; empty
tables give empty results; further columns are ignored; long texts are read in
slices, cut between pieces where there are any.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, mix64, pack_arrays, save, shuffle_partitions, string_array, text_slices, unpack_arrays, word_spans

BLOCK_BYTES = 6 << 20
#: Words of a phrase at most.
LONGEST = 4
#: Windows of a prefix class, about: what a task unites at once.
CLASS_WINDOWS = 3 << 19
#: Frequent paths of a class, about, when parts are looked up.
CLASS_PATHS = 1 << 14
BLOCKS = "block long, lang string, n long, n_words int, words array<string>, counts array<long>, body binary"
BLOCKS_ARROW = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("n", pa.int64()), ("n_words", pa.int32()),
                          ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("body", pa.binary())])
PARTS = "lang string, class long, body binary"
PARTS_ARROW = pa.schema([("lang", pa.string()), ("class", pa.int64()), ("body", pa.binary())])
PATHS = "lang string, w1 long, w2 long, w3 long, w4 long, size int, n long, whole boolean"
PATHS_ARROW = pa.schema([("lang", pa.string()), *((f"w{k}", pa.int64()) for k in (1, 2, 3, 4)), ("size", pa.int32()), ("n", pa.int64()), ("whole", pa.bool_())])
WORDS = ["w1", "w2", "w3", "w4"]

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_OUTSIDE = _BREAK.copy()
_OUTSIDE[[0x20, 0x09]] = True
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def to_blocks(docs: DataFrame) -> DataFrame:
    """Per block of text and language: its distinct words with their counts, and
    its texts as places in that list from 1 on, 0 where a piece ends."""

    def run(batches):
        block = TaskContext.get().partitionId() << 32
        for rows, data, offs, _, _ in text_slices(batches, BLOCK_BYTES, lambda before, at: _BREAK[at]):
            low = _LOWER[data]
            start, end = word_spans(low, offs, _OUTSIDE)
            doc = np.searchsorted(offs, start, "right") - 1
            ends = np.append(0, np.cumsum(_BREAK[low]))[start] + doc  # grows from one piece to the next
            words = string_array(low, start, end).cast(pa.string()).dictionary_encode()
            code = words.indices.to_numpy().astype(np.int64)
            langs = rows.column(2).cast(pa.string()).dictionary_encode()
            lang = langs.indices.to_numpy()[doc] if len(doc) else np.zeros(0, np.int64)
            for k, name in enumerate(langs.dictionary.to_pylist()):
                mine = np.flatnonzero(lang == k)
                if not len(mine):
                    continue
                used, place, count = np.unique(code[mine], return_inverse=True, return_counts=True)
                piece = ends[mine]
                at = np.arange(len(mine)) + np.append(0, np.cumsum(piece[1:] != piece[:-1]))
                body = np.zeros(int(at[-1]) + 1, np.uint32)
                body[at] = place + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block]), pa.array([name]), pa.array([len(mine)]), pa.array([len(body)], pa.int32()),
                     pa.array([words.dictionary.take(pa.array(used))], pa.list_(pa.string())), pa.array([count], pa.list_(pa.int64())),
                     pa.array([pack_arrays(body)], pa.binary())], schema=BLOCKS_ARROW)
                block += 1

    return docs.select(F.lit(0).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                       F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")).mapInArrow(run, BLOCKS)


def sorted_windows(ids: np.ndarray) -> np.ndarray:
    """Up to four words from each place on, in order; 0 where a piece has ended."""
    words = np.unique(ids)
    if words[0] > 0:
        words = np.append(0, words)
    rank = np.searchsorted(words, ids)
    padded = np.append(rank, np.zeros(LONGEST - 1, np.int64))
    columns = [padded[k:len(ids) + k].copy() for k in range(LONGEST)]
    for k in range(1, LONGEST):
        columns[k] *= columns[k - 1] > 0
    columns = [c[columns[0] > 0] for c in columns]
    if len(words) <= 1 << 16:  # a window is one number
        key = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            key = key << np.uint64(16) | c.astype(np.uint64)
        key.sort()
        columns = [(key >> np.uint64(16 * (LONGEST - 1 - k)) & np.uint64(0xFFFF)).astype(np.int64) for k in range(LONGEST)]
    else:
        order = np.lexsort(columns[::-1])
        columns = [c[order] for c in columns]
    return np.stack([words[c] for c in columns], axis=1)


class Paths:
    """Sorted distinct paths with their counts, a level for each length.

    Level k holds the last word of each path of k words, its count, and the
    place of the path it goes on from in the level before (of the root, for the
    first words: there may be several automata side by side).
    """

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.levels = levels

    @staticmethod
    def of_windows(windows: np.ndarray, root: np.ndarray | None = None) -> Paths:
        """From windows sorted by root and words."""
        levels, parent = [], np.zeros(len(windows), np.int64) if root is None else root
        for k in range(LONGEST):
            word = windows[:, k]
            if not word.all():
                live = word > 0
                windows, word, parent = windows[live], word[live], parent[live]
            new = np.ones(len(word), bool)
            new[1:] = (word[1:] != word[:-1]) | (parent[1:] != parent[:-1])
            first = np.flatnonzero(new)
            levels.append((word[first], np.diff(np.append(first, len(word))), parent[first]))
            parent = np.cumsum(new) - 1
        return Paths(levels)

    def words(self, k: int) -> np.ndarray:
        """The paths of k + 1 words."""
        out = np.zeros((len(self.levels[k][0]), k + 1), np.int64)
        at = np.arange(len(out))
        for j in range(k, -1, -1):
            word, _, above = self.levels[j]
            out[:, j] = word[at]
            at = above[at]
        return out

    @staticmethod
    def union(parts: list[Paths]) -> Paths:
        """All paths of the parts, weights summed: level by level, equal extensions of equal paths become one."""
        levels, places = [], [np.zeros(1, np.int64) for _ in parts]  # where each part's paths of the level before are now
        for k in range(LONGEST):
            word = np.concatenate([p.levels[k][0] for p in parts])
            count = np.concatenate([p.levels[k][1] for p in parts])
            above = np.concatenate([at[p.levels[k][2]] for p, at in zip(parts, places)])
            key = above << 32 | word
            order = np.argsort(key, kind="stable")
            key = key[order]
            new = np.ones(len(order), bool)
            new[1:] = key[1:] != key[:-1]
            first = np.flatnonzero(new)
            now = np.empty(len(order), np.int64)
            now[order] = np.cumsum(new) - 1
            key = key[first]
            levels.append((key & 0xFFFFFFFF, np.add.reduceat(count[order], first) if len(first) else count, key >> 32))
            cuts = np.cumsum([0, *(len(p.levels[k][0]) for p in parts)])
            places = [now[a:z] if z > a else np.zeros(0, np.int64) for a, z in zip(cuts, cuts[1:])]
        return Paths(levels)

    def compose(self, queries: np.ndarray) -> np.ndarray:
        """The weight of each query (rows of words, 0 behind the last), 0 where there is no such path:
        all queries go along the automaton's transitions together, word by word."""
        at, weight = np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64)
        live = np.arange(len(queries))
        for k in range(queries.shape[1]):
            word, count, above = self.levels[k]
            more = queries[live, k] > 0
            live = live[more]
            if not len(live):
                break
            have, want = above << 32 | word, at[live] << 32 | queries[live, k]
            found = np.minimum(np.searchsorted(have, want), max(len(have) - 1, 0))
            hit = have[found] == want if len(have) else np.zeros(len(want), bool)
            weight[live] = np.where(hit, count[found] if len(have) else 0, 0)
            live, found = live[hit], found[hit]
            at[live] = found
        return weight


class Automaton:
    """A count transducer as arrays: for each level the number of transitions of
    its states, and for each transition the word, the weight and the state behind."""

    @staticmethod
    def build(paths: Paths, roots: int) -> list[bytes]:
        """The automata of ``roots`` sets of sorted paths, the last words first.

        A level's states are numbered when all their transitions are known, and
        those of one transition that are equal within an automaton get one
        number; states of more transitions are hardly ever equal and are kept apart.
        """
        owner = [np.arange(roots)]  # the automaton of each path
        for _, _, above in paths.levels:
            owner.append(owner[-1][above])
        state = np.zeros(len(paths.levels[-1][0]), np.int64)  # behind the last words: state 0, without transitions
        out = []
        for k in range(LONGEST - 1, -1, -1):
            word, count, above = paths.levels[k]
            mine = owner[k]
            size = np.bincount(above, minlength=len(mine))
            begin = np.cumsum(size) - size
            number = np.zeros(len(mine), np.int64)
            if k:
                one, more = np.flatnonzero(size == 1), np.flatnonzero(size > 1)
                t = begin[one]
                wide, many = int(state.max(initial=0)) + 1, int(count[t].max(initial=0)) + 1
                if int(word.max(initial=0) + 1) * wide * many < 1 << 62:
                    label = (word[t] * wide + state[t]) * many + count[t]
                else:
                    label = np.unique(np.stack([word[t], state[t], count[t]]), axis=1, return_inverse=True)[1].reshape(-1)
                order = np.argsort(label, kind="stable")
                order = order[np.argsort(mine[one[order]].astype(np.uint32 if roots > 1 << 16 else np.uint16), kind="stable")]
                of, label = mine[one[order]], label[order]
                new = np.ones(len(order), bool)
                new[1:] = (label[1:] != label[:-1]) | (of[1:] != of[:-1])
                keep = np.concatenate([one[order[new]], more])
                by = np.argsort(mine[keep], kind="stable")
                place = np.empty(len(keep), np.int64)
                place[by] = np.arange(len(by))
                number[one[order]] = place[np.cumsum(new) - 1] + 1
                number[more] = place[int(new.sum()):] + 1
                keep = keep[by]
            else:
                keep, number = np.arange(roots), np.arange(1, roots + 1)
            n = size[keep]
            at = np.repeat(begin[keep] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            cuts = np.searchsorted(mine[keep], np.arange(roots + 1))
            ends = np.append(0, np.cumsum(n))[cuts]
            out.append((n, word[at], count[at], state[at], cuts, ends))
            # An automaton's own numbers begin with 1.
            state = np.where(number > 0, number - cuts[mine], 0) if k else number
        raw = []
        for r in range(roots):
            arrays = []
            for n, word, count, state, cuts, ends in reversed(out):
                a, z = ends[r], ends[r + 1]
                arrays += [n[cuts[r]:cuts[r + 1]], word[a:z], count[a:z], state[a:z]]
            head = np.array([len(x) for x in arrays], "<u4").tobytes()
            planes = b"".join(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :w].T).tobytes() for x, w in zip(arrays, Automaton.BYTES))
            raw.append(head + len(planes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True))
        return raw

    #: Bytes of each array's numbers, level by level.
    BYTES = (4, 4, 6, 4) * LONGEST

    @staticmethod
    def paths(raw: bytes) -> Paths:
        """All paths of an automaton, sorted."""
        sizes = np.frombuffer(raw[:16 * LONGEST], "<u4").tolist()
        planes = np.frombuffer(pa.decompress(raw[16 * LONGEST + 8:], int.from_bytes(raw[16 * LONGEST:16 * LONGEST + 8], "little"), "zstd", asbytes=True), np.uint8)
        at, levels, state, arrays = 0, [], np.ones(1, np.int64), []
        for n, w in zip(sizes, Automaton.BYTES):
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :w] = planes[at:at + n * w].reshape(w, n).T
            arrays.append(wide.reshape(-1).view("<i8"))
            at += n * w
        for k in range(LONGEST):
            n, word, weight, behind = arrays[4 * k:4 * k + 4]
            n = np.append(0, n)  # state 0
            begin = np.cumsum(n) - n
            of = n[state]
            where = np.repeat(begin[state] - (np.cumsum(of) - of), of) + np.arange(int(of.sum()))
            levels.append((word[where], weight[where], np.repeat(np.arange(len(state)), of)))
            state = behind[where]
        return Paths(levels)


def frequent_paths(blocks: DataFrame, vocabulary: DataFrame, classes: int, least: int) -> DataFrame:
    """lang, the words' ids (0: none), size and count n of every phrase of one to
    four words that occurs ``least`` times."""
    spark = blocks.sparkSession

    def dealt(windows: np.ndarray, deals: np.ndarray) -> np.ndarray:
        """The prefix class of each window; ``deals``: how many classes its first word takes."""
        spread = mix64(windows[:, 1].astype(np.uint64) << np.uint64(32) | windows[:, 2].astype(np.uint64)) % deals.astype(np.uint64)
        return (windows[:, 0] + spread.astype(np.int64)) % classes * 2 + (deals > 1)

    def emit(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return PARTS_ARROW.empty_table()
        ids, deals = np.zeros(right.column("of")[0].as_py() + 1, np.int64), np.ones(1, np.int64)
        place, known = right.column("place").to_numpy() + 1, right.column("id").to_numpy()
        ids[place] = known
        order = np.argsort(known)
        deals = right.column("deals").to_numpy()[order]
        text = unpack_arrays(left.column("body")[0].as_py(), left.column("n_words")[0].as_py(), np.uint32)[0]
        windows = sorted_windows(ids[text])
        part = dealt(windows, deals[np.searchsorted(known[order], windows[:, 0])])
        used, root = np.unique(part, return_inverse=True)
        by = np.argsort(root.astype(np.uint32 if len(used) > 1 << 16 else np.uint16), kind="stable")
        lang = left.column("lang")[0].as_py()
        out = Automaton.build(Paths.of_windows(windows[by], root[by]), len(used))
        return pa.table([pa.array([lang] * len(out), pa.string()), pa.array(used, pa.int64()), pa.array(out, pa.binary())], schema=PARTS_ARROW)

    def unite(t: pa.Table) -> pa.Table:
        paths = Paths.union([Automaton.paths(x.as_py()) for x in t.column("body")])
        lang, shared = t.column("lang")[0].as_py(), t.column("class")[0].as_py() % 2
        out = []
        for k in range(LONGEST):
            words, n = paths.words(k), paths.levels[k][1]
            whole = not shared or k >= 2  # others have their share in further classes
            here = np.flatnonzero(n >= least) if whole else np.arange(len(n))
            columns = [words[here, j] if j <= k else np.zeros(len(here), np.int64) for j in range(LONGEST)]
            out.append(pa.table([pa.array([lang] * len(here), pa.string()), *map(pa.array, columns), pa.array(np.full(len(here), k + 1, np.int32)),
                                 pa.array(n[here]), pa.array(np.full(len(here), whole))], schema=PATHS_ARROW))
        return pa.concat_tables(out)

    places = (blocks.select("block", "lang", F.size("words").alias("of"), F.posexplode("words").alias("place", "word"))
              .join(vocabulary.select("lang", "word", "id", "deals"), ["lang", "word"]).select("block", "of", "place", "id", "deals"))
    text = spark.read.schema(blocks.schema).parquet(blocks.shared_path).select("block", "lang", "n_words", "body")
    parts = text.groupBy("block").cogroup(places.groupBy("block")).applyInArrow(lambda a, b: emit(a, b), PARTS)
    paths = save(parts.groupBy("lang", "class").applyInArrow(lambda t: unite(t), PATHS), "paths")
    again = spark.read.schema(paths.schema).parquet(paths.shared_path)
    summed = (again.where("not whole").groupBy("lang", *WORDS, "size").agg(F.sum("n").alias("n")).where(F.col("n") >= least))
    return paths.where("whole").drop("whole").unionByName(summed)


def part_counts(paths: DataFrame) -> DataFrame:
    """For every candidate and cut: words, size, count a, k, and counts l and r of both parts."""
    spark = paths.sparkSession
    classes = max(shuffle_partitions(spark), paths.count() // CLASS_PATHS)
    paths = save(paths.withColumn("class", F.pmod("w1", F.lit(classes))), "frequent")
    again = lambda: spark.read.schema(paths.schema).parquet(paths.shared_path)
    cuts = "lang string, w1 long, w2 long, w3 long, w4 long, size int, a long, k int, l long, r long, q1 long, q2 long, q3 long, class long"
    arrow = pa.schema([(f.split()[0], {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[f.split()[1]]) for f in cuts.split(", ")])

    def automaton(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, Paths]:
        """The class's paths in order. Every path's beginnings are frequent too, so they are here."""
        words = np.stack([t.column(c).to_numpy() for c in WORDS], axis=1)
        order = np.lexsort(words.T[::-1])
        words, size, n = words[order], t.column("size").to_numpy()[order], t.column("n").to_numpy()[order]
        own = Paths.of_windows(words)
        for k in range(LONGEST):  # a path's own row tells its count
            own.levels[k] = (own.levels[k][0], n[size == k + 1], own.levels[k][2])
        return words, size, n, own

    def first_parts(t: pa.Table) -> pa.Table:
        words, size, n, own = automaton(t)
        lang, out = t.column("lang")[0].as_py(), []
        for k in range(1, LONGEST):
            here = words[size > k]
            first, rest = here.copy(), np.zeros((len(here), LONGEST - 1), np.int64)
            first[:, k:] = 0
            rest[:, :LONGEST - k] = here[:, k:]
            out.append(pa.table([pa.array([lang] * len(here), pa.string()), *(pa.array(here[:, j]) for j in range(LONGEST)), pa.array(size[size > k], pa.int32()),
                                 pa.array(n[size > k]), pa.array(np.full(len(here), k, np.int32)), pa.array(own.compose(first)),
                                 pa.array(np.zeros(len(here), np.int64)), *(pa.array(rest[:, j]) for j in range(3)),
                                 pa.array(rest[:, 0] % classes)], schema=arrow))
        return pa.concat_tables(out)

    def rests(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return arrow.empty_table()
        own = automaton(left)[3]
        r = own.compose(np.stack([right.column(f"q{k}").to_numpy() for k in (1, 2, 3)], axis=1))
        return right.select(arrow.names).set_column(arrow.get_field_index("r"), "r", pa.array(r)).cast(arrow)

    asked = paths.groupBy("lang", "class").applyInArrow(lambda t: first_parts(t), cuts)
    return (again().groupBy("lang", "class").cogroup(asked.groupBy("lang", "class")).applyInArrow(lambda a, b: rests(a, b), cuts)
            .drop("q1", "q2", "q3", "class"))


def mine(docs: DataFrame, least: int = 30, top: int = 2000, share: int = 80) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases."""
    spark = docs.sparkSession
    blocks = save(to_blocks(docs), "blocks")
    counted = (blocks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x"))
               .groupBy("lang", F.col("x.words").alias("word")).agg(F.sum("x.counts").alias("f")).where(F.col("f") >= least))
    # Dense ids, frequent words first: a range sort, then each partition's rows from where the one before ends.
    numbered = save(counted.orderBy(F.desc("f"), "lang", "word").withColumn("row", F.monotonically_increasing_id()), "words")
    sizes = {r["part"]: r["n"] for r in numbered.groupBy(F.shiftright("row", 33).alias("part")).agg(F.count("*").alias("n")).collect()}
    begin, total = [], 1
    for part in sorted(sizes):
        begin.append((part, total))
        total += sizes[part]
    offsets = spark.createDataFrame(begin or [(0, 1)], "part long, begin long")  # a row a partition
    kept = numbered.join(F.broadcast(offsets), F.shiftright("row", 33) == F.col("part"))
    kept = kept.select("lang", "word", "f", (F.col("row").bitwiseAND((1 << 33) - 1) + F.col("begin")).alias("id"))
    windows = kept.agg(F.sum("f")).first()[0] or 0
    classes = max(1, -(-int(windows) // CLASS_WINDOWS))
    vocabulary = save(kept.withColumn("deals", F.least(F.lit(classes), F.ceil(F.col("f") * 2 / CLASS_WINDOWS)).cast("long")), "vocabulary")
    drop(numbered)
    paths = frequent_paths(blocks, vocabulary, classes, least)
    cuts = save(part_counts(paths), "cuts")
    score = F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0))) div cast(l + r as decimal(20,0))")
    scored = (cuts.withColumn("score", score).groupBy("lang", *WORDS, "size", "a")
              .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")))
    # What a longer candidate holds: its parts of two words and more; each with the most frequent holder.
    held = [(b, k) for k in range(2, LONGEST) for b in range(LONGEST - k + 1)]
    part = lambda b, k: F.struct(*((F.col(WORDS[b + j]) if j < k else F.lit(0).cast("long")).alias(w) for j, w in enumerate(WORDS)))
    again = spark.read.schema(cuts.schema).parquet(cuts.shared_path)
    longer = (again.where("k = 1 and size > 2")
              .select("lang", "a", F.explode(F.array(*(F.when((F.col("size") >= b + k) & (F.col("size") > k), part(b, k)) for b, k in held))).alias("x"))
              .where("x is not null").select("lang", "x.*", "a").groupBy("lang", *WORDS).agg(F.max("a").alias("longer")))
    stay = scored.join(longer, ["lang", *WORDS], "left").where(F.expr(f"longer is null or cast(longer as decimal(20,0)) * 100 < cast(a as decimal(20,0)) * {share}"))
    spelt = (stay.select("lang", *WORDS, "a", "cut", F.posexplode(F.array(*WORDS)).alias("place", "id")).where("id > 0")
             .join(vocabulary.select("id", "word"), "id").groupBy("lang", *WORDS, "a", "cut")
             .agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("words"))
             .select("lang", F.expr("array_join(transform(words, x -> x.word), ' ')").alias("phrase"), "a",
                     F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").cast("long").alias("score")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    first = spelt.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    totals = blocks.groupBy("lang").agg(F.sum("n").alias("n"))
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
