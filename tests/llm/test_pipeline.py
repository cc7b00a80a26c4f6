"""The pipeline, stage by stage, against plain versions; and on hard tables."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
import corpus_pipeline as P  # noqa: E402
import data  # noqa: E402

from clickforge.llm import decontaminate, quality  # noqa: E402
from clickforge.llm.common import read, save  # noqa: E402

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def stages(spark):
    """The docs before each stage and the last result, each written and read again."""
    out = [read(spark, SF, "documents")]
    for name, stage in P.STAGES:
        out.append(save(stage(spark, out[-1], SF), name))
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in P.STAGES] == ["quality", "near_copies", "repeats", "benchmarks", "packing"]
    assert all(d.columns == COLUMNS for d in stages[:-1])
    sizes = [d.count() for d in stages[:-1]]
    assert sizes == sorted(sizes, reverse=True) and 0 < sizes[-1] < sizes[0]


def test_rejected_documents_go(spark, stages):
    good = quality.classify(stages[0], read(spark, SF, "labels")).where("predicted = 1").select("doc_id")
    assert rows(stages[1]) == rows(stages[0].join(good, "doc_id").select(COLUMNS))


def test_one_of_each_group_stays(stages):
    texts = {r["doc_id"]: r["text"] for r in stages[1].collect()}
    smallest = brute.components({i: brute.fingerprint(t) for i, t in texts.items()}, 3)
    assert {r["doc_id"] for r in stages[2].collect()} == {i for i, c in smallest.items() if i == c}


def test_repeats_are_cut(stages):
    before = sorted((r["doc_id"], r["text"]) for r in stages[2].collect())
    want = dict(zip((i for i, _ in before), brute.removed(before, 100)))
    after = {r["doc_id"]: r for r in stages[3].collect()}
    for (i, text) in before:
        n, gone, _, _ = want[i]
        if gone == 0:
            assert after[i]["text"] == text
        elif i in after:
            assert 0 <= n - gone - len(after[i]["text"].encode()) <= 6 * want[i][2]  # halves of characters at cuts
        else:
            assert n - gone < 4
    assert all(r["n_chars"] == len(r["text"]) for r in after.values())


def test_contaminated_documents_go(spark, stages):
    import duckdb
    con = duckdb.connect()
    con.register("documents", stages[3].toPandas())
    con.register("benchmark", read(spark, SF, "benchmark").toPandas())
    clean = {r[0] for r in con.execute(f"SELECT doc_id FROM ({decontaminate.oracle_sql()}) WHERE NOT contaminated").fetchall()}
    assert {r["doc_id"] for r in stages[4].collect()} == clean


def test_all_tokens_are_packed(stages):
    out = stages[5].collect()
    assert {r["doc_id"] for r in out} == {r["doc_id"] for r in stages[4].collect()}
    total = {}
    for r in out:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert all(total[r["doc_id"]] == r["doc_tokens"] for r in out)


@pytest.mark.parametrize("which", ["repeated", "empty"])
def test_hard_tables(spark, tmp_path, which):
    sf = str(tmp_path)
    docs = getattr(data, which)(spark)
    docs.write.parquet(f"{sf}/documents.parquet")
    labels = [(r["doc_id"], i % 2) for i, r in enumerate(docs.collect())]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{sf}/labels.parquet")
    bench = [(1, None), (2, ""), (3, data.texts()[11])] if which == "repeated" else []
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    current = read(spark, sf, "documents")
    for _, stage in P.STAGES[:-1]:
        after = save(stage(spark, current, sf), "stage")
        assert after.columns == current.columns
        current = after
    assert (P.run(spark, sf).count() == 0) == (which == "empty")


def test_rows_of_one_id(spark):
    """One row of each component stays, whatever ids its rows share with others."""
    schema = "doc_id long, text string, lang string"
    a, b = "one text here that stands alone", "quite another text of other words"
    cases = [([(5, a), (7, a), (5, b), (3, b)], [(3, b), (5, a)]),
             ([(1, a), (1, a), (1, b), (2, a)], [(1, a), (1, b)]),
             ([(None, a), (None, None), (1, a), (2, None), (2, "")], None)]
    for rows, want in cases:
        out = P.without_near_copies(spark, spark.createDataFrame([(*r, "x") for r in rows], schema), "")
        assert out.columns == ["doc_id", "text", "lang"]
        got = sorted((r["doc_id"], r["text"]) for r in out.where("doc_id is not null").collect())
        if want:
            assert got == want
        else:
            assert out.where("doc_id is null").count() == 2 and len(got) == 2 and got[0] == (1, a) and got[1][0] == 2


def test_every_component_keeps_one_row(spark):
    docs = data.repeated(spark)
    groups = {}
    for r in docs.where("doc_id is not null").collect():
        groups.setdefault(brute.fingerprint(r["text"]), []).append(r)
    ids = {k: i for i, k in enumerate(groups)}
    smallest = brute.components({i: k for k, i in ids.items()}, 3)
    kept = P.without_near_copies(spark, docs, "").where("doc_id is not null").collect()
    assert sorted(smallest[ids[brute.fingerprint(r["text"])]] for r in kept) == sorted(set(smallest.values()))
