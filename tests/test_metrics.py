"""Ranking and loss metrics against an independent numpy implementation
written from the published formulas, on hand-made edge tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickforge.operators import metrics as M


def np_auc(y, p):
    y, p = np.asarray(y), np.asarray(p, dtype=float)
    pos, neg = p[y == 1], p[y == 0]
    if len(pos) == 0 or len(neg) == 0:
        return None
    gt = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    return gt / (len(pos) * len(neg))


def np_ap(y, p):
    """Step-wise AP over distinct thresholds: sum (R_t - R_{t-1}) * P_t."""
    y, p = np.asarray(y), np.clip(np.asarray(p, dtype=float), 1e-15, 1 - 1e-15)
    P = y.sum()
    if P == 0 or P == len(y):
        return 0.0
    ap = 0.0
    for t in sorted(set(p), reverse=True):
        sel = p >= t
        tp = y[sel].sum()
        pos_t = y[p == t].sum()
        ap += (pos_t / P) * (tp / sel.sum())
    return ap


def table(spark, y, p, model="a"):
    return spark.createDataFrame([(model, int(a), float(b)) for a, b in zip(y, p)],
                                 "model string, clicked int, p double")


CASES = [
    ([1, 0, 1, 0, 1, 0, 0, 0], [0.9, 0.9, 0.5, 0.5, 0.5, 0.1, 0.1, 0.0]),      # ties across classes
    ([0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8]),
    ([1, 1, 0, 0, 0], [0.0, 1.0, 1.0, 1e-20, 0.5]),                          # clipped zones
    ([0, 1, 0, 1, 0, 0], [0.2, 0.2, 0.2, 0.2, 0.2, 0.2]),                    # all tied
]


@pytest.mark.parametrize("y,p", CASES)
def test_auc_ap_match_numpy(spark, y, p):
    r = M.ranking_metrics(table(spark, y, p), ["model"], bounded=True).first()
    assert r["auc"] == pytest.approx(np_auc(y, p), abs=1e-12)
    assert r["ap"] == pytest.approx(np_ap(y, p), abs=1e-12)


def test_single_class_defaults(spark):
    r = M.metric_row(table(spark, [0, 0, 0], [0.1, 0.2, 0.3]), ["model"]).first()
    assert r["auc"] is None and r["ap"] == 0.0 and r["log_loss"] == 100.0
    assert r["combined_score"] == 0.0 and r["accuracy"] == 0.0
    assert r["actual_ctr"] == 0.0 and r["predicted_ctr"] == pytest.approx(0.2)
    assert math.isinf(r["ctr_relative_error"])


def test_non_finite_score_defaults(spark):
    r = M.metric_row(table(spark, [0, 1, 0], [0.1, float("nan"), 0.3]), ["model"]).first()
    assert r["auc"] is None and r["log_loss"] == 100.0


def test_log_losses_match_numpy(spark):
    y = np.array([1, 0, 0, 1, 0, 0, 0, 1])
    p = np.array([0.8, 0.1, 0.3, 0.4, 1e-20, 0.99, 0.05, 0.6])
    pc = np.clip(p, 1e-15, 1 - 1e-15)
    ll = -(y * np.log(pc) + (1 - y) * np.log(1 - pc))
    w = np.where(y == 1, 49.8, 1.0)
    r = M.loss_metrics(table(spark, y, p), ["model"], digits=None).first()
    assert r["log_loss"] == pytest.approx(ll.mean(), rel=1e-12)
    assert r["weighted_log_loss"] == pytest.approx(np.average(ll, weights=w), rel=1e-12)
    bal = 0.5 * (-np.log(1 - pc[y == 0]).mean()) + 0.5 * (-np.log(pc[y == 1]).mean())
    assert r["balanced_log_loss"] == pytest.approx(bal, rel=1e-12)


def test_auc_invariant_under_monotone_rescale(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 300)
    p = np.round(rng.random(300), 2)
    a = M.ranking_metrics(table(spark, y, p), ["model"], bounded=True).first()["auc"]
    b = M.ranking_metrics(table(spark, y, p ** 3 / 7), ["model"], bounded=True).first()["auc"]
    assert a == pytest.approx(b, abs=1e-12)
    assert a == pytest.approx(np_auc(y, p), abs=1e-12)


def test_ap_rowwise_matches_manual(spark):
    y = [1, 0, 1, 0, 1, 0]
    p = [0.9, 0.9, 0.5, 0.5, 0.5, 0.1]
    keys = [f"{i:032x}" for i in range(6)]
    df = spark.createDataFrame([("a", k, a, b) for k, a, b in zip(keys, y, p)],
                               "model string, row_key string, clicked int, p double")
    r = M.ap_rowwise(df, ["model"], bounded=True, digits=None).first()["ap_rowwise"]
    order = sorted(range(6), key=lambda i: (-p[i], keys[i]))
    tp, s = 0, 0.0
    for rank, i in enumerate(order, start=1):
        if y[i] == 1:
            tp += 1
            s += tp / rank
    assert r == pytest.approx(s / 3, abs=1e-12)


def test_ctr_score_steps(spark):
    df = spark.createDataFrame([(b,) for b in [0.00005, 0.0003, 0.0007, 0.0015, 0.003, 0.02]], "b double")
    got = [r[0] for r in df.select(M.ctr_score_expr(F.col("b"))).collect()]
    assert got == pytest.approx([1.0, 0.9, 0.7, 0.5, 0.7, 0.0])


def rowwise(y, p, keys):
    order = sorted(range(len(y)), key=lambda i: (-p[i], keys[i]))
    tp, total = 0, 0.0
    for n, i in enumerate(order, 1):
        tp += y[i]
        total += y[i] * tp / n
    return total / sum(y) if sum(y) else 0.0


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_range_layout_carries_over_parts(spark, parts):
    """A score that a third of the rows share, ties across parts and batches, single classes, one huge and many small groups."""
    rng = np.random.default_rng(parts)
    rows = []
    for i in range(4000):
        g = "hot" if i < 2500 else f"g{i % 9}"
        p = 0.125 if i < 1300 else float(rng.choice([rng.random(), 0.5, 0.0, 1.0, 1e-20, 1 - 1e-17]))
        rows.append((g, int(rng.random() < 0.2) if g != "g3" else 0, p, f"k{i * 7919 % 4000:04d}"))
    rows += [(None, 1, 0.3, "a"), (None, 0, 0.3, "b"), ("alone", 1, 0.3, "c"), ("hot", None, 0.9, "d")]
    df = spark.createDataFrame(rows, "g string, clicked int, p double, k string").repartition(7)
    auc = {r["g"]: r for r in M.ranking_from_rows(df, ["g"], buckets=parts).collect()}
    old = {r["g"]: r for r in M.ranking_from_counts(M.score_counts(df, ["g"]), ["g"]).collect()}
    by_row = {r["g"]: r["ap_rowwise"] for r in M.ap_rowwise(df, ["g"], key="k", buckets=parts, digits=None).collect()}
    assert set(auc) == set(old) == set(by_row)
    for g in auc:
        mine = [r for r in rows if r[0] == g and r[1] is not None]
        y, p, k = ([r[j] for r in mine] for j in (1, 2, 3))
        want = np_auc(y, p)
        assert auc[g]["auc"] == (None if want is None else pytest.approx(want, abs=1e-12))
        assert auc[g]["ap"] == pytest.approx(np_ap(y, p) if 0 < sum(y) < len(y) else 0.0, abs=1e-12)
        assert old[g]["ap"] == pytest.approx(auc[g]["ap"], abs=1e-12)
        assert by_row[g] == pytest.approx(rowwise(y, p, k), abs=1e-12)
    whole = M.ranking_from_rows(df, [], buckets=parts).first()
    y, p = [r[1] for r in rows if r[1] is not None], [r[2] for r in rows if r[1] is not None]
    assert whole["auc"] == pytest.approx(np_auc(y, p), abs=1e-12) and whole["ap"] == pytest.approx(np_ap(y, p), abs=1e-12)


def test_one_exchange_of_the_rows(spark):
    """The layout shuffles the rows once, by range; what follows reads blocks and clicks."""
    from clickforge.operators.ranking import BLOCK, tie_blocks
    df = spark.range(1000).selectExpr("id % 3 as g", "cast(id % 50 = 0 as int) as y", "id / 1000.0 as p")
    blocks, totals = tie_blocks(df, ["g"], "p", "y", 1.0, 0.0, 4)
    assert blocks.agg(F.sum("__pos")).first()[0] == 20 and totals.agg(F.sum("__n")).first()[0] == 1000
    assert blocks.count() == 20 and set(blocks.columns) <= {"g", *BLOCK}
