"""Byte-level BPE against the tiktoken library."""

from __future__ import annotations

import base64
import hashlib
import os
import random
import sys
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import data  # noqa: E402

from clickforge.llm import byte_bpe  # noqa: E402

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.ByteBpe(RANKS, PATTERN)


def texts():
    rng = random.Random(3)
    letters = "aAbt's  \n\t.,!12é日 　 \x00\x1c\x85’"
    out = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    return out + ["a" * 3000, "ab" * 2000, "日本語" * 500, "'ll" * 90, " " * 999 + "x", "<|endoftext|>", "😀👍🏽" * 40]


def test_texts_and_slices(library, bpe):
    for t in texts():
        want = library.encode_ordinary(t)
        assert bpe.encode(t) == want, repr(t)
        raw = np.frombuffer(t.encode(), np.uint8)
        ids, at = bpe.encode_slice(raw, np.array([0, 0, len(raw)]))
        assert ids.tolist() == want and at.tolist() == [0, 0, len(want)]
        assert bpe.decode(ids).tobytes() == t.encode()


def test_long_match_and_side_by_side_agree(bpe):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeforstinghé") for _ in range(rng.randint(1, 15))).encode() for _ in range(500)]
    ids, count = bpe.merge_many([w for w in words if w not in bpe.rank and len(w) <= 32], 32)
    one_by_one = [bpe.merge(w) for w in words if w not in bpe.rank and len(w) <= 32]
    assert count.tolist() == list(map(len, one_by_one)) and ids.tolist() == sum(one_by_one, [])


@pytest.mark.parametrize("which", ["documents", "repeated", "empty"])
def test_digests(spark, library, which):
    table = getattr(data, which)(spark)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter()
    for r in table.collect():
        ids = library.encode_ordinary(r["text"] or "")
        want[r["doc_id"], len(ids), sha(np.array(ids, "<u4").tobytes()), sha((r["text"] or "").encode())] += 1
    assert Counter(tuple(r) for r in byte_bpe.digests(table, RANKS, PATTERN).collect()) == want
    coded = byte_bpe.encode(table, RANKS, PATTERN)
    back = byte_bpe.decode(coded, RANKS, PATTERN)
    assert Counter((r["doc_id"], bytes(r["decoded"]).decode()) for r in back.collect()) == Counter((r["doc_id"], r["text"] or "") for r in table.collect())


def test_a_text_of_several_slices(spark, library):
    rng = random.Random(9)
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(900_000)) + "\n" * 500 + "end"
    assert len(long) > 2 * byte_bpe.SLICE_BYTES
    table = spark.createDataFrame([(1, long), (2, "short"), (3, "z" * 50_000)], "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r for r in byte_bpe.digests(table, RANKS, PATTERN).collect()}
    for i, t in ((1, long), (2, "short"), (3, "z" * 50_000)):
        ids = library.encode_ordinary(t)
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    coded = byte_bpe.encode(table, RANKS, PATTERN).collect()
    assert {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() == library.encode_ordinary({1: long, 2: "short", 3: "z" * 50_000}[r["doc_id"]]) for r in coded} == {1: True, 2: True, 3: True}
