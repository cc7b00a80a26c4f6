"""Divergence of sources against plain Python and its SQL."""

from __future__ import annotations

import os
import random
import re
import sys
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
import data  # noqa: E402

from clickforge.llm import divergence  # noqa: E402


def plain(rows, min_docs, top):
    """(lang, source, part, item, value, rank) of (text, lang, source) rows."""
    count, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(brute.FOLD))
        groups[lang or ""].add(source or "")
        count[lang or "", source or ""].update(terms)
        df[lang or ""].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= min_docs]
        whole = Counter()
        for s in sources:
            whole.update(count[lang, s])
        p = {}
        for s in [*sources, None]:
            c = whole if s is None else count[lang, s]
            under = sum(c[t] for t in kept) + 5 * len(kept)
            p[s] = {t: 1 + (10**9 * (c[t] + 5)) // under for t in kept}
        for s in sources:
            far = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s))
            out += [(lang, s, "pair", o.decode(), -v, k + 1) for k, (v, o) in enumerate(far)]
            over = sorted((p[None][t] - p[s][t], t.encode()) for t in kept if count[lang, s][t] and p[s][t] > p[None][t])
            out += [(lang, s, "term", t.decode(), -v, k + 1) for k, (v, t) in enumerate(over[:top])]
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("which", ["documents", "repeated", "empty"])
@pytest.mark.parametrize("min_docs, shard", [(1, 1 << 20), (3, 40), (10**6, 1 << 20)])
def test_equals_plain(spark, monkeypatch, which, min_docs, shard):
    monkeypatch.setattr(divergence, "SHARD_TERMS", shard)
    table = getattr(data, which)(spark)
    rows = [(r["text"], r["lang"], r["source"]) for r in table.collect()]
    assert result(divergence.audit(table, min_docs, 7)) == plain(rows, min_docs, 7)


def test_equals_sql(spark):
    table = data.documents(spark)
    con = duckdb.connect()
    con.register("documents", table.toPandas())
    rows = con.execute(f"SELECT lang, source, part, item, value, rank FROM ({divergence.oracle_sql(2, 9)})").fetchall()
    assert sorted(rows) == result(divergence.audit(table, 2, 9))


def test_shares_are_exact():
    rng = random.Random(2)
    for _ in range(200):
        kept, total = rng.randint(1, 10**8), rng.choice([rng.randint(0, 100), rng.randint(0, 10**14), 1 << 60])
        n = [rng.randint(0, min(total, 10**15)) for _ in range(5)] + [0, total]
        assert divergence.shares(np.array(n), total, kept).tolist() == [1 + (10**9 * (x + 5)) // (total + 5 * kept) for x in n]


def test_galloping_finds_what_both_hold():
    rng = np.random.default_rng(3)
    for size, of, run in [(0, 50, 4), (5, 1000, 2), (300, 400, 16), (1, 1, 1), (200, 100_000, 8), (50, 0, 4)]:
        want, have = np.sort(rng.choice(200_000, size, False)), np.sort(rng.choice(200_000, of, False))
        have = np.union1d(have, want[::3]) if of else have
        at, k = divergence.gallop(have, want, run)
        assert have[at].tolist() == want[k].tolist() == np.intersect1d(have, want).tolist()


def test_a_long_text_counts_as_one_document(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SLICE_BYTES", 50)
    rows = [("alpha beta " * 40 + "gamma " + "x" * 300 + " alpha", "en", "a"), ("beta gamma", "en", "b"), ("alpha", "en", "b")]
    table = spark.createDataFrame(rows, "text string, lang string, source string").coalesce(1)
    assert result(divergence.audit(table, 2, 5)) == plain(rows, 2, 5)
