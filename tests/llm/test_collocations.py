"""Collocations against plain Python."""

from __future__ import annotations

import os
import random
import re
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
import data  # noqa: E402

from clickforge.llm import collocations  # noqa: E402


def plain(rows, least, top):
    """(lang, rank, phrase, a, l, r, n, score) of (text, lang) rows."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(brute.FOLD)):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(w[b:b + k] for b in range(len(w) - k + 1))
    out = []
    for lang, of in f.items():
        able = {p: a for p, a in of.items() if len(p) > 1 and a >= least}
        gone = {p[b:b + k] for p, a in able.items() for k in range(2, len(p)) for b in range(len(p) - k + 1) if 100 * a >= 80 * able.get(p[b:b + k], 10**9)}
        found = []
        for p, a in able.items():
            if p not in gone:
                score, k = min((2000000 * a // (of[p[:k]] + of[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), of[p[:k]], of[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def result(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("which", ["documents", "repeated", "empty"])
@pytest.mark.parametrize("least, small", [(2, True), (3, False), (10**6, False)])
def test_equals_plain(spark, monkeypatch, which, least, small):
    if small:  # many classes, words dealt to several, many slices
        monkeypatch.setattr(collocations, "CLASS_WINDOWS", 40)
        monkeypatch.setattr(collocations, "CLASS_PATHS", 50)
        monkeypatch.setattr(collocations, "BLOCK_BYTES", 700)
    table = getattr(data, which)(spark)
    rows = [(r["text"], r["lang"]) for r in table.collect()]
    want = plain(rows, least, 60)
    assert result(collocations.mine(table, least, 60)) == want
    assert bool(want) == (which != "empty" and least < 100)


def test_hot_words_and_langs(spark, monkeypatch):
    monkeypatch.setattr(collocations, "CLASS_WINDOWS", 30)
    rng = random.Random(8)
    words = ["the", "of", "a", "b", "c", "d\x00", "é"]
    rows = [(" ".join(rng.choice(words) for _ in range(50)) + rng.choice([".", "!", "\n", ""]) + "the  of\tA, x", rng.choice([None, "und", "", "en"])) for _ in range(60)]
    rows += [("of the line that stands everywhere; Of the Line that stands everywhere", "en")] * 40
    table = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    assert result(collocations.mine(table, 5, 2000)) == plain(rows, 5, 2000)


def test_automata_give_their_paths_back():
    rng = np.random.default_rng(2)
    for n, of in [(0, 5), (1, 3), (400, 4), (3000, 70), (500, 100_000)]:
        text = rng.integers(0, of, n)
        if not n:
            text = np.zeros(3, np.int64)
        windows = collocations.sorted_windows(text)
        plain_counts = [Counter() for _ in range(4)]
        for w in windows.tolist():
            for k in range(4):
                if w[k]:
                    plain_counts[k][tuple(w[:k + 1])] += 1
        root = windows[:, 0] % 3
        by = np.argsort(root, kind="stable")
        automata = collocations.Automaton.build(collocations.Paths.of_windows(windows[by], root[by]), 3)
        back = [collocations.Automaton.paths(a) for a in automata]
        twice = collocations.Paths.union(back + back[::-1])
        for k in range(4):
            got = dict(zip(map(tuple, twice.words(k).tolist()), twice.levels[k][1].tolist()))
            assert got == {p: 2 * c for p, c in plain_counts[k].items()}
        queries = np.array([[*p, *[0] * (4 - len(p))] for c in plain_counts for p in c] + [[of + 9, 0, 0, 0]])
        assert twice.compose(queries).tolist() == [2 * c for count in plain_counts for c in count.values()] + [0]


def test_equal_states_are_merged():
    text = np.array(sum(([k, 7, 8, 9, 0] for k in range(10, 60)), []))
    paths = collocations.Paths.of_windows(collocations.sorted_windows(text))
    raw = collocations.Automaton.build(paths, 1)[0]
    states = np.frombuffer(raw[:64], "<u4").reshape(4, 4)[:, 0].tolist()
    assert states[0] == 1 and states[1] < 5 and states[2] < 5 and states[3] == 1
