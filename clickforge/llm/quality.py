"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of each whole text are computed in numpy, block by block. The model
is fitted on at most ``max_rows`` labelled documents (those with the smallest
hash of their id, a bound that does not grow with the input); their statistics
are binned by quantiles, and trees are grown level by level from histograms of
gradients. The fitted trees are flattened into arrays of complete binary trees
and scored for all documents at once, one vectorised step a level.

Cases: null or empty text has statistics of zeros and gets a score; null labels
are ignored, and a document with several labels counts with the lowest; without
labelled documents nothing is known to be bad and every score is 1; with labels
of one class the score is that class; empty tables give empty results; repeated
rows are scored each; labels, lang, source and ids are no inputs of the score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PrefixHash, documents, mix64, space_table, text_blocks, word_spans

#: Byte classes whose share of the text is a statistic (ASCII; the last is all other bytes).
CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".", b",", b"!", b"?",
           b"'\"", b"-_", b":;", b"|", b"#*$%&<>", b"()[]{}", b"/\\@", b"+=~^`", bytes(range(128, 256))]
N_FEATURES = len(CLASSES) + 15
SCORED = "doc_id long, score double"
SCORED_ARROW = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def _per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between the positions ``at`` (n + 1 of them)."""
    total = np.append(0, np.cumsum(values, dtype=np.int64))
    return total[at[1:]] - total[at[:-1]]


def _distinct(doc: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each text, and the count of its most frequent one."""
    if not len(key):
        return np.zeros(n), np.zeros(n)
    joint = mix64(key ^ mix64(doc.astype(np.uint64) + np.uint64(1)))
    _, first, count = np.unique(joint, return_index=True, return_counts=True)
    most = np.zeros(n)
    np.maximum.at(most, doc[first], count)
    return np.bincount(doc[first], minlength=n).astype(float), most


def statistics(data: np.ndarray, offs: np.ndarray, hashing: PrefixHash) -> np.ndarray:
    """A row of statistics for each text of a block."""
    n = len(offs) - 1
    table = np.full(256, len(CLASSES) + 1, np.uint8)
    for k, members in enumerate(CLASSES):
        table[list(members)] = k
    size = np.diff(offs).astype(float)
    doc_of = np.repeat(np.arange(n), np.diff(offs))
    kinds = np.bincount(doc_of * 32 + table[data], minlength=n * 32).reshape(n, 32)
    per = np.maximum(size, 1)
    prefix = hashing.prefix(data)

    start, end = word_spans(data, offs, space_table())
    doc = np.searchsorted(offs, start, "right") - 1
    words = np.bincount(doc, minlength=n).astype(float)
    each = np.maximum(words, 1)
    length = end - start
    key = hashing.spans(prefix, start, end)
    distinct, top = _distinct(doc, key, n)
    upper = np.append(0, np.cumsum(table[data] == 1))
    capitals = (upper[end] - upper[start] == length) & (length > 1)
    letters = (table[data[end - 1]] < 2) | (data[end - 1] > 127) if len(end) else np.zeros(0, bool)
    bare = table[data[start]] >= 9 if len(start) else np.zeros(0, bool)

    def runs(k: int) -> tuple[np.ndarray, np.ndarray]:
        last = np.arange(len(start) - k + 1) + k - 1
        inside = doc[last] == doc[last - k + 1] if len(last) else np.zeros(0, bool)
        joint = np.zeros(len(last), np.uint64)
        for j in range(k):
            joint = mix64(joint * np.uint64(31) + key[j:j + len(last)])
        d = doc[:len(last)][inside]
        return _distinct(d, joint[inside], n)[0], np.bincount(d, minlength=n)

    pairs, all_pairs = runs(2) if len(start) > 1 else (np.zeros(n), np.zeros(n))
    fours, all_fours = runs(4) if len(start) > 3 else (np.zeros(n), np.zeros(n))

    line = np.zeros(256, bool)
    line[10] = True
    ls, le = word_spans(data, offs, line)
    ldoc = np.searchsorted(offs, ls, "right") - 1
    lines = np.bincount(ldoc, minlength=n).astype(float)
    dlines, _ = _distinct(ldoc, hashing.spans(prefix, ls, le), n)
    every = np.maximum(lines, 1)
    stops = np.isin(data[np.maximum(le - 1, 0)], list(b".!?:")) if len(le) else np.zeros(0, bool)
    short = (le - ls) < 30

    mean = lambda v, who, by: np.bincount(who, v.astype(float), n) / by
    columns = [np.log1p(size), np.log1p(words), mean(length, doc, each), np.sqrt(mean(length ** 2, doc, each)),
               distinct / each, top / each, mean(capitals, doc, each), mean(letters, doc, each), mean(bare, doc, each),
               pairs / np.maximum(all_pairs, 1), fours / np.maximum(all_fours, 1),
               np.log1p(lines), 1 - dlines / every, mean(stops, ldoc, every), mean(short, ldoc, every)]
    return np.column_stack([kinds[:, :len(CLASSES)] / per[:, None], *columns])


class Trees:
    """Boosted complete binary trees, flattened: node 0 is the root, the children
    of i are 2i + 1 and 2i + 2, the leaves come after the inner nodes."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray, depth: int):
        self.base, self.feature, self.threshold, self.leaf, self.depth = base, feature, threshold, leaf, depth

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.feature):
            return np.full(len(x), self.base)
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        for _ in range(self.depth):
            right = x[rows, self.feature[trees, node]] > self.threshold[trees, node]
            node = 2 * node + 1 + right
        raw = self.base + self.leaf[trees, node - (2 ** self.depth - 1)].sum(1)
        return 1 / (1 + np.exp(-raw))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64,
        smooth: float = 1.0, least: int = 10) -> Trees:
    """Newton boosting of the logistic loss over binned statistics."""
    nothing = np.zeros((0, 0), np.int64)
    if not len(y):
        return Trees(1.0, nothing, nothing, nothing, depth)
    if y.min() == y.max():
        return Trees(float(y[0]), nothing, nothing, nothing, depth)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])  # bin b: edges[b-1] < v <= edges[b]
    base = float(np.log(y.mean() / (1 - y.mean())))
    raw = np.full(len(y), base)
    inner = 2 ** depth - 1
    feature, threshold = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            width, low = 2 ** level, 2 ** level - 1
            here = node - low
            best, choice = np.zeros(width), [(0, -1)] * width
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                cell, m = here * (bins + 1) + binned[:, j], width * (bins + 1)
                g, h, c = (np.bincount(cell, w, m).reshape(width, -1).cumsum(1) for w in (grad, hess, np.ones(len(y))))
                gl, hl, cl = g[:, :len(e)], h[:, :len(e)], c[:, :len(e)]
                gt, ht, ct = g[:, -1:], h[:, -1:], c[:, -1:]
                gain = gl ** 2 / (hl + smooth) + (gt - gl) ** 2 / (ht - hl + smooth) - gt ** 2 / (ht + smooth)
                gain[(cl < least) | (ct - cl < least)] = 0
                at = gain.argmax(1)
                for k in np.flatnonzero(gain[np.arange(width), at] > best + 1e-9):
                    best[k], choice[k] = gain[k, at[k]], (j, at[k])
            cut = np.full(width, bins + 1)
            which = np.zeros(width, np.int64)
            for k, (j, b) in enumerate(choice):
                if b >= 0:
                    which[k], cut[k] = j, b
                    feature[t, low + k], threshold[t, low + k] = j, edges[j][b]
            node = 2 * node + 1 + (binned[np.arange(len(y)), which[here]] > cut[here])
        g, h = (np.bincount(node - inner, w, inner + 1) for w in (grad, hess))
        leaf[t] = rate * g / (h + smooth)
        raw += leaf[t][node - inner]
    return Trees(base, feature, threshold, leaf, depth)


def _statistics_of(docs: DataFrame, extra: str) -> DataFrame:
    def run(batches):
        hashing = PrefixHash(3)
        for rows, data, offs in text_blocks(batches):
            x = statistics(data, offs, hashing)
            yield pa.record_batch([rows.column(2), pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(
                pa.list_(pa.float64()))], names=["y", "x"])

    return docs.select("doc_id", "text", extra).mapInArrow(run, "y int, x array<double>")


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, held_out: int = 2, folds: int = 4, **options) -> Trees:
    """Fit on labelled documents outside fold ``held_out``; at most ``max_rows``
    of them reach the driver, the bounded sample of this operator."""
    usable = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
              .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull())
              .where(F.crc32(F.col("doc_id").cast("string")) % folds != held_out)
              .groupBy("doc_id").agg(F.min("y").alias("y")))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = _statistics_of(documents(docs).join(F.broadcast(sample), "doc_id"), "y").toArrow()
    if not rows.num_rows:
        return fit(np.zeros((0, 1)), np.zeros(0))
    y = rows.column("y").to_numpy().astype(float)
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(len(y), -1)
    order = np.lexsort((*x.T[::-1], y))  # the fit doesn't depend on the order in which tasks end
    return fit(x[order], y[order], **options)


def score(docs: DataFrame, model: Trees) -> DataFrame:
    """doc_id and score of every whole text."""

    def run(batches):
        hashing = PrefixHash(3)
        for rows, data, offs in text_blocks(batches):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(model.score(statistics(data, offs, hashing)))],
                                             schema=SCORED_ARROW)

    return documents(docs).mapInArrow(run, SCORED)


def keep_good(docs: DataFrame, model: Trees, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least ``threshold``."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    ordered = docs.select("doc_id", "text", *rest)

    def run(batches):
        hashing = PrefixHash(3)
        for rows, data, offs in text_blocks(batches):
            yield rows.filter(pa.array(model.score(statistics(data, offs, hashing)) >= threshold))

    return ordered.mapInArrow(run, ordered.schema).select(docs.columns)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, held_out: int = 2, folds: int = 4,
             max_rows: int = 20_000) -> DataFrame:
    """doc_id, held_out, score, predicted (1: score >= ``threshold``)."""
    scored = score(docs, train(docs, labels, max_rows, held_out, folds))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held_out, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"),
                         "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
