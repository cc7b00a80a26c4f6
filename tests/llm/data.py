"""Small tables with the hard cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, print long, term string, pos int, n int, w string"


def texts(seed: int = 5) -> list[str | None]:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, line = prose(60), prose(8)
    out: list[str | None] = [None, "", " ", "\n\n \t", "a", "A b", "the same", "the same", "aaaa " * 400, "ab" * 700, "x" * 5000]
    out += [prose(40) + ". " + passage + " " + prose(30) for _ in range(6)]
    out += [line + "\n" + prose(20) + "\n" + line + "\n" + line for _ in range(3)]
    copy = prose(120)
    out += [copy, copy, copy.replace(" ", "  ", 1), copy.upper(), copy + " " + prose(1), copy[:300] + "Ünïcödé 日本語 " + copy[300:]]
    out += ["don't  stop <|endoftext|> it's <|startoftext|> 12 345,6! #* $%& |<> \x01 　 é. à\n", "### %%% *** &&& " * 20]
    out += [prose(4000), " ".join([passage] * 3), "Released under the MIT License.\nLicensed under the Apache License,\nVersion 2.0."]
    out += [prose(rng.randint(1, 80)) for _ in range(40)]
    return out


def rows() -> list[tuple]:
    out = []
    for i, t in enumerate(texts()):
        lang = [None, "en", "de"][i % 3]
        out.append((i * 3, t, lang, f"s{i % 2}" if i % 5 else None, len(t or ""), 0.5, i, "the", 1, 2, "w"))
    return out


def documents(spark, extra: list[tuple] = ()):
    return spark.createDataFrame([*rows(), *extra], SCHEMA).repartition(4, "doc_id")


def repeated(spark):
    """Rows that share a doc_id, whole or with other texts, and rows without one."""
    first = rows()[11]
    return documents(spark, [first, (first[0], "another text of the same id", *first[2:]), (None, first[1], *first[2:]), (None, None, *first[2:])])


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
