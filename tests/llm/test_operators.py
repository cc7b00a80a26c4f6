"""Each operator of the subpackage against plain versions on small, hard tables."""

from __future__ import annotations

import os
import random
import sys
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
import data  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from clickforge.llm.common import save  # noqa: E402
from clickforge.llm.units import UnitEncoder  # noqa: E402
from clickforge.llm import (  # noqa: E402
    components, decontaminate, huffman, kneser_ney, licenses, packing, quality, quality_rules, simhash, suffix_dedup, token_counts)

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return data.documents(spark).cache()


@pytest.fixture(scope="module")
def plain():
    return {r[0]: r[1] for r in data.rows()}


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# 1. Quality classifier

def test_trees_separate_and_flatten():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    model = quality.fit(x[:1000], y[:1000], trees=40)
    p = model.score(x[1000:])
    assert ((p > 0.5) == y[1000:]).mean() > 0.95

    def walk(row):
        raw = model.base
        for f, t, leaf in zip(model.feature, model.threshold, model.leaf):
            node = 0
            for _ in range(model.depth):
                node = 2 * node + 1 + int(row[f[node]] > t[node])
            raw += leaf[node - (2 ** model.depth - 1)]
        return 1 / (1 + np.exp(-raw))

    assert np.allclose(p[:50], [walk(r) for r in x[1000:1050]])


def test_statistics_of_one_text_do_not_depend_on_its_block(plain):
    from clickforge.llm.common import PrefixHash
    raw = [(t or "").encode() for t in plain.values()]
    offs = np.append(0, np.cumsum([len(b) for b in raw]))
    together = quality.statistics(np.frombuffer(b"".join(raw), np.uint8), offs, PrefixHash(3))
    for i, b in enumerate(raw):
        alone = quality.statistics(np.frombuffer(b, np.uint8), np.array([0, len(b)]), PrefixHash(3))
        assert np.allclose(together[i], alone[0]), i
    assert np.isfinite(together).all()


def test_classifier_scores_every_row(spark, docs, plain):
    labels = spark.createDataFrame([(i, int("#" not in (t or "")), 0, 9.0) for i, t in plain.items()] + [(None, 1, 0, 1.0), (0, None, 0, 1.0)],
                                   "doc_id long, quality int, toxic int, score double")
    out = quality.classify(docs, labels).collect()
    assert len(out) == len(plain) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out)
    assert {r["doc_id"]: r["held_out"] for r in out} == {i: brute.in_fold(i, 4, 2) for i in plain}
    none = quality.classify(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {1.0}
    assert quality.classify(data.empty(spark), labels).count() == 0


def test_classifier_learns_only_from_its_folds(spark, docs, plain):
    labels = [(i, int(len(t or "") > 100)) for i, t in plain.items()]
    turned = [(i, 1 - q if brute.in_fold(i, 4, 2) else q) for i, q in labels]
    a, b = (quality.classify(docs, spark.createDataFrame(x, "doc_id long, quality int")).orderBy("doc_id").collect() for x in (labels, turned))
    assert a == b


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    out = quality.classify(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    held = out.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    rank, good = held.score.rank(), held.quality == 1
    auc = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.97


# 2. Packing

def test_fill_is_a_best_subset_sum():
    rng = np.random.default_rng(3)
    for _ in range(200):
        counts = Counter(rng.integers(1, 40, rng.integers(1, 12)).tolist())
        capacity = int(rng.integers(40, 80))
        chosen = packing.fill(dict(counts), capacity)
        assert all(n <= counts[k] for k, n in chosen.items()) and max(counts) in chosen
        sums = {0}
        rest = counts - Counter([max(counts)])
        for x in rest.elements():
            sums |= {s + x for s in sums if s + x <= capacity - max(counts)}
        assert sum(k * n for k, n in chosen.items()) == max(counts) + max(sums)


def test_units_of_one_hash_are_told_apart():
    """Complementary Thue-Morse words have one polynomial hash modulo 2**64, whatever its base."""
    bits = [bin(k).count("1") % 2 for k in range(2048)]
    one, two = ("".join("ab"[b ^ x] for b in bits) for x in (0, 1))
    encoder, lib = UnitEncoder(BYTE), Tokenizer.from_file(BYTE)
    texts = [one, two, f"x {two} y", "plain words", one]
    for group in (texts, texts[::-1], [two], [one], ["words", two + " " + one]):
        raw = [t.encode() for t in group]
        ids, at = encoder.encode_block(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(b) for b in raw])))
        assert [ids[a:z].tolist() for a, z in zip(at, at[1:])] == [lib.encode(t, add_special_tokens=False).ids for t in group]


@pytest.mark.parametrize("parts", [0, 2048])
@pytest.mark.parametrize("which", ["documents", "repeated", "empty"])
def test_packing_is_whole(spark, monkeypatch, which, parts):
    monkeypatch.setattr(packing, "BROADCAST_PARTS", parts)
    check_packing(spark, which)


def check_packing(spark, which):
    table = getattr(data, which)(spark)
    lib = Tokenizer.from_file(BYTE)
    ids = lambda t: np.array(lib.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
    want = Counter((r["doc_id"], ids(r["text"]).tobytes()) for r in table.collect())
    cut = save(packing.pieces(table, BYTE, window=64), "pieces")
    out = packing.pack(cut, window=64).collect()
    sequences = {}
    for r in out:
        assert len(r["ids"]) == 4 * r["length"] and 0 < r["length"] <= 64
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    pieces = Counter((r["doc_id"], r["start"], r["ids"], r["doc_tokens"]) for r in out)
    expected = Counter((d, s, b[4 * s:4 * s + 256], len(b) // 4) for (d, b), n in want.items() for _ in range(n) for s in range(0, len(b) // 4, 64))
    assert pieces == expected
    if out:
        total = sum(r["length"] for r in out)
        assert len(sequences) <= total / 64 * 1.02 + 2


def test_sequences_are_joined_and_padded(spark, docs):
    packed = packing.pack(save(packing.pieces(docs, BYTE, window=64), "pieces"), window=64)
    rows = packed.collect()
    for r in packing.sequences(packed, window=64, pad_id=7).collect():
        parts = sorted((x["offset"], x["ids"]) for x in rows if x["sequence_id"] == r["sequence_id"])
        own = b"".join(x for _, x in parts)
        n = len(own) // 4
        pad = 0 if n & (n - 1) == 0 else 64 - n
        assert bytes(r["ids"]) == own + (7).to_bytes(4, "little") * pad


# 3. Language model

@pytest.mark.parametrize("which", ["documents", "repeated", "empty"])
def test_language_model(spark, which):
    scores_agree(getattr(data, which)(spark), 3)


@pytest.mark.parametrize("order", [1, 2, 4])
def test_language_model_of_other_orders(spark, docs, monkeypatch, order):
    monkeypatch.setattr(kneser_ney, "GRAMS", 200)  # tasks hand on n-grams more than once
    scores_agree(docs, order)


def test_language_model_buckets_follow_the_texts(spark, docs, monkeypatch):
    """A bucket hands a row to each other one: the partitions alone must not raise them."""
    monkeypatch.setattr(kneser_ney, "shuffle_partitions", lambda spark: 211)
    assert kneser_ney.train(docs.select("doc_id", "text")).buckets == 8
    scores_agree(docs, 3)
    monkeypatch.setattr(kneser_ney, "BUCKET_BYTES", 50)
    scores_agree(docs, 2)


@pytest.mark.parametrize("kind", ["spread", "alike", "crowded"])
def test_language_model_tables_find_what_was_put(tmp_path, kind):
    """Every key with its values, also where 40 bits and the cell are the same, and in cells of many keys."""
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 2**64, 5000, dtype=np.uint64)
    if kind == "alike":  # the cell and the lower 40 bits are those of another key
        keys = np.append(keys, keys ^ np.uint64(1 << 40))
    if kind == "crowded":
        keys[:400] = np.uint64(7 << 60) | np.arange(400, dtype=np.uint64) << np.uint64(16)
    keys = np.unique(keys)
    total, once = (rng.integers(1, 4, len(keys)) for _ in range(2))
    total[::50] = rng.integers(1, 2**62, len(total[::50]))
    kneser_ney._put_table(str(tmp_path), "t", 0, keys, [total, once])
    table = kneser_ney.Table(str(tmp_path), "t-0")
    order = rng.permutation(len(keys))
    at = table.find(keys[order])
    assert (at == order).all()
    assert (table.values(at, lambda v: v) == np.array([total, once])[:, order]).all()
    assert (table.find(rng.integers(0, 2**64, 5000, dtype=np.uint64)) == -1).all()
    assert (table.tag.itemsize == 4) == (kind == "alike")
    assert (kneser_ney.Table(str(tmp_path), "none-0").find(keys) == -1).all()


def test_language_model_discounts_that_leave_nothing(spark):
    """Without an n-gram counted twice the discount of one is one; contexts of such n-grams are still found."""
    texts = [(i, " ".join(f"w{i}x{j}" for j in range(12))) for i in range(40)]
    again = next(i for i in range(1000, 2000) if brute.in_fold(i, 7, 2))
    scores_agree(spark.createDataFrame([*texts, (again, texts[0][1] + " " + texts[1][1])], "doc_id long, text string"), 3)


def test_language_model_size_on_disk(spark, tmp_path, monkeypatch):
    """At most seven bytes for an n-gram or a context of many."""
    monkeypatch.setattr(kneser_ney, "new_path", lambda spark, name: f"{tmp_path}/{name}")
    rng = random.Random(5)
    texts = [[f"w{rng.randrange(3000)}" for _ in range(2000)] for _ in range(20)]
    kneser_ney.train(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"))
    padded = [["", "", *t, ""] for t in texts]
    entries = sum(len({tuple(t[i:i + n]) for t in padded for i in range(len(t) - n + 1 - cut)}) for n, cut in ((3, 0), (2, 0), (2, 1), (1, 1)))
    size = sum(f.stat().st_size for f in (tmp_path / "lm").iterdir() if f.name.startswith(("gram", "ctx", "hot", "times")))
    assert size < 7 * entries + 8 * 6 * 8 * 300  # and the frequent values of each table


def scores_agree(table, order):
    rows = [(r["doc_id"], r["text"]) for r in table.collect()]
    want = sorted(((-1 if i is None else i, *x) for (i, _), x in zip(rows, brute.lm(rows, 7, 2, order))))
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"])
                 for r in kneser_ney.score(table, order=order).collect())
    assert len(want) == len(got)
    for a, b in zip(want, got):
        assert a[:5] == b[:5] and np.allclose(a[5:], b[5:], rtol=1e-9)


def test_language_model_without_training_texts(spark):
    only = next(i for i in range(100) if brute.in_fold(i, 7, 2))
    (r,) = kneser_ney.score(spark.createDataFrame([(only, "a b")], "doc_id long, text string")).collect()
    assert (r["train_tokens"], r["n_tokens"], r["n_known"], r["base_score"], r["score"]) == (0, 3, 0, 0.0, 0.0)


def test_model_folder_must_be_mounted():
    assert kneser_ney.local_path("file:///a/b") == "/a/b" and kneser_ney.local_path("/a/b") == "/a/b"
    with pytest.raises(ValueError):
        kneser_ney.local_path("hdfs://host/a")


# 4. Suffix-array dedup

def test_difference_cover():
    for v in (7, 13, 21, 31, 57, 73, 91):
        d = suffix_dedup.difference_cover(v)
        assert sorted((a - b) % v for a in d for b in d if a != b) == list(range(1, v))


@pytest.mark.parametrize("length", [100, 30])
def test_repeats_are_removed(spark, docs, plain, length):
    rows = sorted(plain.items())
    want = dict(zip((i for i, _ in rows), brute.removed(rows, length)))
    out = suffix_dedup.deduplicate(docs, length, keep=["lang", "score"]).selectExpr("*", "sha2(kept, 256) sha").collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["sha"]) for r in out} == want
    langs = {r[0]: r[2] for r in data.rows()}
    assert all(r["lang"] == langs[r["doc_id"]] and r["score"] == 0.5 for r in out)
    assert any(x[1] for x in want.values())


def test_repeats_over_many_blocks(spark, docs, plain, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 700)
    rows = sorted(plain.items())
    want = dict(zip((i for i, _ in rows), brute.removed(rows, 40)))
    out = suffix_dedup.deduplicate(docs, 40).selectExpr("*", "sha2(kept, 256) sha").collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["sha"]) for r in out} == want


def test_repeats_among_rows_of_one_id(spark):
    text = "".join(chr(97 + i * i % 23) + chr(97 + i * 7 % 19) for i in range(150))
    table = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text[:120]), (3, None)], "doc_id long, text string").coalesce(1)
    out = [(r["doc_id"], r["n_removed"]) for r in suffix_dedup.deduplicate(table).collect()]
    assert sorted(out, key=str) == sorted([(None, 0), (1, 300), (1, 300), (2, 120), (3, 0)], key=str)
    assert suffix_dedup.deduplicate(data.empty(spark)).count() == 0


def test_cut_characters_are_dropped(spark):
    a = "é" * 60 + "x"
    table = spark.createDataFrame([(1, a), (2, "y" + a)], "doc_id long, text string")
    out = {r["doc_id"]: r["kept"] for r in suffix_dedup.deduplicate(table, as_text=True).collect()}
    assert out[2] == "y" and "�" not in out[1]


# 5. SimHash

def test_golay_code_covers():
    code = simhash.GolayCode()
    rng = np.random.default_rng(2)
    v = rng.integers(0, 1 << 23, 300)
    e = code.errors(v)
    assert all(int(x).bit_count() <= 3 for x in e)
    words = code.near[0]
    for x, err in zip(v, e):
        assert code.errors(np.array([x ^ err]))[0] == 0
        for w in code.near[int(err)]:
            assert int(w ^ err).bit_count() <= 4 and code.errors(np.array([x ^ err ^ w]))[0] == 0
    assert (words == 0).sum() == 1


def test_pairs_within_three_bits_meet():
    code, rng = simhash.GolayCode(), np.random.default_rng(4)
    for _ in range(150):
        x = int(rng.integers(0, 2**64, dtype=np.uint64))
        y = x
        for b in rng.choice(64, rng.integers(0, 4), replace=False):
            y ^= 1 << int(b)
        who, key, home = simhash.keyed(np.array([x, y], np.uint64), code)
        homes = {k for w, k, h in zip(who, key, home) if w == 0 and h}
        near = {k for w, k in zip(who, key) if w == 1}
        assert len(homes) == 8 and homes & near


def test_simhash_components(docs, plain):
    prints = {i: brute.fingerprint(t) for i, t in plain.items()}
    want = brute.components(prints, 3)
    out = by_id(simhash.near_duplicates(docs))
    assert {i: r["fingerprint"] for i, r in out.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r["component_id"] for i, r in out.items()} == want


def test_simhash_clusters_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 8)
    monkeypatch.setattr(simhash, "SMALL", 20)
    rng = np.random.default_rng(6)
    prints = {}
    for c in range(6):
        centre = int(rng.integers(0, 2**64, dtype=np.uint64))
        for k in range(60):
            p = centre
            for b in rng.choice(64, rng.integers(0, 5), replace=False):
                p ^= 1 << int(b)
            prints[c * 100 + k] = p
    table = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in prints.items()], "doc_id long, print long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, shingle: docs)
    out = by_id(simhash.near_duplicates(table))
    assert {i: r["component_id"] for i, r in out.items()} == brute.components(prints, 3)


def test_simhash_repeated_and_empty(spark):
    out = simhash.near_duplicates(data.repeated(spark)).collect()
    assert len(out) == len(data.rows()) + 4
    assert all((r["component_id"] is None) == (r["doc_id"] is None) for r in out)
    assert simhash.near_duplicates(data.empty(spark)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(200, i) for i in range(201, 260)] + [(300, 300), (None, 4), (401, 400)]
    out = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**{i: 0 for i in range(61)}, **{i: 200 for i in range(200, 260)}, 400: 400, 401: 400}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# 6, 7, 9: against SQL on hard rows

def duck(spark, sql, docs, bench=None):
    import duckdb
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    if bench is not None:
        con.register("benchmark", bench.toPandas())
    rows = con.execute(sql).fetchall()
    return sorted((dict(zip((c[0] for c in con.description), r)).items() for r in rows), key=str)


def spark_rows(df):
    return sorted((r.asDict().items() for r in df.collect()), key=str)


def same(spark, got, want):
    canon = lambda x: Counter(str(sorted((k, None if v != v else int(v) if isinstance(v, float) else v) for k, v in i)) for i in x)
    assert canon(spark_rows(got)) == canon(want)


def bench_rows():
    t = data.texts()
    return [(1, t[11]), (2, "A b"), (3, None), (4, ""), (5, "a"), (6, t[11]), (7, (t[20] or "")[:200]), (10, " ".join((t[15] or "").split()[:30])), (10, "nowhere at all")]


@pytest.mark.parametrize("which", ["documents", "repeated", "empty"])
def test_contamination(spark, which):
    from pyspark.sql import functions as F
    table = getattr(data, which)(spark)
    bench = spark.createDataFrame([(*r, 1, "x") for r in bench_rows()], "item_id long, text string, n int, term string")
    got = decontaminate.contamination(table, bench).select("doc_id", "n_words", "n_hit", "n_items", F.sha2("items", 256).alias("items_sha256"), "contaminated", "n_near")
    if which == "empty":
        assert got.count() == 0
    else:
        same(spark, got, duck(spark, decontaminate.oracle_sql(), table, bench))
        assert decontaminate.contamination(table, bench.limit(0)).where("n_hit > 0").count() == 0


def test_contamination_without_broadcast(spark, docs, monkeypatch):
    bench = spark.createDataFrame(bench_rows(), "item_id long, text string")
    want = spark_rows(decontaminate.contamination(docs, bench))
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert spark_rows(decontaminate.contamination(docs, bench)) == want


def test_proximity_matches(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    moved = item.replace("two three", "two extra three")
    table = spark.createDataFrame([(1, f"x {item} y"), (2, f"x {moved} y"), (3, "nothing here")], "doc_id long, text string")
    _, found = decontaminate.matches(table, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert {(r["doc_id"], r["exact"]) for r in found.collect()} == {(1, True), (2, False)}
    near = decontaminate.contamination(table, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert {r["doc_id"]: (r["n_hit"], r["n_near"]) for r in near.collect()} == {1: (13, 0), 2: (0, 1), 3: (0, 0)}


def test_quality_rules(spark):
    for table in (data.documents(spark), data.repeated(spark)):
        same(spark, quality_rules.apply_rules(table).drop("lang", "source"), duck(spark, quality_rules.oracle_sql(), table))
    assert quality_rules.apply_rules(data.empty(spark)).count() == 0


def test_quality_sketches_merge(spark, docs):
    counted = quality_rules.text_counts(docs).where("n_words >= 20")
    whole = spark_rows(quality_rules.sketches(counted))
    parts = quality_rules.sketches(counted.where("doc_id % 2 = 0")).unionAll(quality_rules.sketches(counted.where("doc_id % 2 = 1")))
    assert spark_rows(parts.groupBy("lang", "source", "ratio", "value").sum("n").withColumnRenamed("sum(n)", "n")) == whole


def prose_rows(n, junk, source, start=0):
    """``n`` documents of one source, of which the last ``junk`` are full of symbols."""
    rng = random.Random(n)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    texts = [" ".join(word() + (" #$% *|<" if i >= n - junk else "") for _ in range(60)) for i in range(n)]
    return [(start + i, t, "en", source) for i, t in enumerate(texts)]


@pytest.mark.parametrize("junk", [5, 10, 20, 30])
def test_junk_does_not_move_the_bounds(spark, junk):
    table = spark.createDataFrame(prose_rows(100, junk, "s"), "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"] for r in quality_rules.apply_rules(table).where("kept").collect()}
    assert kept == set(range(100 - junk))


@pytest.mark.parametrize("lang", ["en", "fr", None])
def test_a_small_group_is_judged_by_its_language_or_all(spark, lang):
    """Groups of five with one or three junk documents beside one large group of English."""
    few = [(i, t, lang, s) for i, t, _, s in prose_rows(5, 1, "few", 500) + prose_rows(5, 3, None, 600)]
    table = spark.createDataFrame(prose_rows(100, 0, "many") + few, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"] for r in quality_rules.apply_rules(table).where("kept").collect()}
    assert kept == {*range(100), *range(500, 504), *range(600, 602)}
    same(spark, quality_rules.apply_rules(table).drop("lang", "source"), duck(spark, quality_rules.oracle_sql(), table))


def test_licenses(spark):
    wrapped = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated\n"
               "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the\n"
               "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit\n"
               "persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and\n"
               "this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED\n"
               "\"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF\n"
               "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. Other words follow.")
    more = [(900, wrapped, *data.rows()[0][2:]), (901, "Licensed under CC BY-NC 4.0. Licensed under CC BY 4.0.", *data.rows()[0][2:])]
    table = data.documents(spark, more)
    got = licenses.scan(table)
    same(spark, got, duck(spark, licenses.oracle_sql(), table))
    found = {i: r["licenses"] for i, r in by_id(got).items()}
    assert found[900] == "MIT" and found[901] == "CC-BY-4.0,CC-BY-NC-4.0" and found[0] == ""
    assert "Apache-2.0,MIT" in found.values()
    assert licenses.scan(data.empty(spark)).count() == 0 and licenses.scan(data.repeated(spark)).count() == len(data.rows()) + 4


MIT = """MIT License

Copyright (c) 2020 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD = """BSD 3-Clause License

Copyright (c) 2020, Jane Doe

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
"""
APACHE = """Copyright 2020 Jane Doe

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
GPL = """Frob, a program
Copyright (C) 2020 Jane Doe

This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""


def test_standard_license_files_are_found(spark):
    comment = lambda t, mark: "".join(f"{mark} {x}".rstrip() + "\n" for x in t.splitlines())
    cases = [(MIT, "MIT"), (BSD, "BSD-3-Clause"), (BSD.replace("3. Neither", "Neither").split("Neither")[0], "BSD-2-Clause"),
             (APACHE, "Apache-2.0"), (GPL, "GPL-3.0-or-later"), (GPL.replace("version 3", "version 2"), "GPL-2.0-or-later"),
             (comment(GPL, "#"), "GPL-3.0-or-later"), ("/*\n" + comment(MIT, " *") + " */\nint x;", "MIT"), (MIT.replace("\n", "\r\n"), "MIT"),
             (GPL.replace("Doe\n\n", "Doe\n"), "GPL-3.0-or-later"), ("Some words on software.\n\n- one\n- two\n", ""),
             ("                                 Apache License\n                           Version 2.0, January 2004\n"
              "                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS\n", "Apache-2.0"),
             ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 FSF\n", "GPL-3.0"),
             ("Frob\n\n" + GPL.split("\n\n")[-1], "GPL"),
             ("Notes\n\nThis work is licensed under the GNU General Public License\nversion 3. Other words.", "GPL-3.0"), (MIT + "\n" + APACHE, "Apache-2.0,MIT")]
    table = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    assert [r["licenses"] for r in licenses.scan(table, paragraphs=True).orderBy("doc_id").collect()] == [x for _, x in cases]


def test_license_tables_are_sound():
    for s in licenses.SENTENCES.values():
        assert any(t in s for t in licenses.TRIGGERS) or "cc by" in s
    seen = set()
    for ids, _ in licenses.RULES:
        assert set(ids) <= set(licenses.SENTENCES) and ids not in seen
        seen.add(ids)


# 8. Token files

def test_code_lengths_are_limited_and_optimal():
    import heapq
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 30, 200):
        counts = {i: int(c) for i, c in enumerate(rng.integers(1, 1000, n))}
        lengths = huffman.code_lengths(counts)
        assert sum(2.0 ** -x for x in lengths.values()) <= 1
        heap = [(c, i) for i, c in counts.items()]
        heapq.heapify(heap)
        cost = 0
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            cost += a[0] + b[0]
            heapq.heappush(heap, (a[0] + b[0], n + cost))
        if n > 1:
            assert sum(counts[i] * x for i, x in lengths.items()) == cost
    skewed = huffman.code_lengths({i: 1 << min(i, 60) for i in range(40)})
    assert max(skewed.values()) <= 16 and sum(2.0 ** -x for x in skewed.values()) <= 1


def test_code_round_trip():
    rng = np.random.default_rng(7)
    for n in (1, 255, 256, 257, 5000):
        ids = (rng.zipf(1.3, n) % 3000).astype(np.uint16)
        code = huffman.Code(huffman.code_lengths(dict(Counter(ids.tolist()))))
        assert np.array_equal(code.decode(*code.encode(ids), n), ids)


@pytest.mark.parametrize("which", ["documents", "repeated", "empty"])
def test_token_files(spark, which):
    table = getattr(data, which)(spark)
    lib = Tokenizer.from_file(WORD)
    rows = sorted(((-1 if r["doc_id"] is None else r["doc_id"], np.array(lib.encode(r["text"] or "", add_special_tokens=False).ids + [1], "<u2").tobytes())
                   for r in table.collect()))
    want, start = [], 0
    for i, raw in rows:
        want.append((i, start, len(raw) // 2, zlib.crc32(np.frombuffer(raw, "<u2").astype("<u4").tobytes())))
        start += len(raw) // 2
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(bytes(r["ids"]))) for r in huffman.round_trip(table, WORD).collect())
    assert got == sorted(want)


# 10. Token counts

@pytest.mark.parametrize("which", ["documents", "repeated", "empty"])
def test_token_counts(spark, which):
    table = getattr(data, which)(spark)
    lib = Tokenizer.from_file(BYTE)
    want = Counter((r["doc_id"], len((r["text"] or "").encode()), n := len(lib.encode(r["text"] or "", add_special_tokens=False).ids), n > 512) for r in table.collect())
    assert Counter(tuple(r) for r in token_counts.token_counts(table, BYTE).collect()) == want


def test_token_counts_of_random_strings():
    import random
    rng, lib = random.Random(9), Tokenizer.from_file(BYTE)
    alphabet = "ab é×÷.,'|<s>treL1٣Ⅷ  　\n\t́ÄßÉ日。dmvl"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 70))) for _ in range(1500)]
    texts += ["'r<|endoftext|>e", "<|endoftext|><|endoftext|>", "  <|endoftext|>  ", " " * 511 + "a", " " * 512 + "a", " " * 1500 + "\n", "'re'rex'll"]
    raw = [t.encode() for t in texts]
    offs = np.append(0, np.cumsum([len(b) for b in raw]))
    counter = token_counts.Counter(BYTE)
    got = token_counts.count_block(counter, token_counts.character_classes(BYTE), token_counts.cutter(), np.frombuffer(b"".join(raw), np.uint8), offs)
    assert got.tolist() == [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_special_string_is_not_found_across_texts():
    raw = [b"a <|endof", b"text|> b"]
    counter, lib = token_counts.Counter(BYTE), Tokenizer.from_file(BYTE)
    got = token_counts.count_block(counter, token_counts.character_classes(BYTE), token_counts.cutter(),
                                   np.frombuffer(b"".join(raw), np.uint8), np.array([0, 9, 17]))
    assert got.tolist() == [len(lib.encode(x.decode(), add_special_tokens=False).ids) for x in raw]


def test_units_equal_the_library():
    import random

    from clickforge.llm.units import UnitEncoder
    rng = random.Random(10)
    alphabet = "ab é×÷.,'|<s>treL1٣  　\n\t́ÄßÉǅ日。\x01\x1c\x85"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 70))) for _ in range(800)]
    texts += ["x<|endoftext|>y z", "<|startoftext|> A", "<|ENDOFTEXT|>", "a <|endof", "text|> b"]
    raw = [t.encode() for t in texts]
    offs = np.append(0, np.cumsum([len(b) for b in raw]))
    for path in (BYTE, WORD):
        encoder = UnitEncoder(path)
        for _ in range(2):  # the second time from the cache
            ids, at = encoder.encode_block(np.frombuffer(b"".join(raw), np.uint8), offs)
            assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [encoder.whole.encode(t, add_special_tokens=False).ids for t in texts]
