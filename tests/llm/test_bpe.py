"""Ids, decoded texts and packed ids against the tokenizer itself, over all code points and odd texts; merges against a
plain search for the next pair."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lexispark.llm import bpe
from lexispark.llm.bpe import Merges, TreeIds, merge_all
from lexispark.llm.packing import WordIds, tokenized
from lexispark.llm.queries import tokenizer_file

FILE = tokenizer_file()
SCHEMA = "doc_id long, text string, ids string, n_tokens int, length int"


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(FILE)


def slow(symbols, ranks, made):
    now = list(symbols)
    while True:
        found = min(((ranks[a << 32 | b], i) for i, (a, b) in enumerate(zip(now, now[1:])) if a << 32 | b in ranks), default=None)
        if found is None:
            return now
        now[found[1] : found[1] + 2] = [made[found[0]]]


@pytest.mark.parametrize("seed", range(6))
def test_merges_are_the_leftmost_lowest_ones(seed):
    rng = random.Random(seed)
    ranks, made = {}, []
    for _ in range(rng.choice([0, 3, 40, 200])):
        pair = rng.randrange(8 + len(made) // 2) << 32 | rng.randrange(8 + len(made) // 2)
        if pair not in ranks:
            ranks[pair] = len(made)
            made.append(8 + len(made) if rng.random() < 0.8 else rng.randrange(8))
    runs = [[rng.randrange(4 if rng.random() < 0.5 else 8) for _ in range(rng.choice([0, 1, 2, 3, 5, 9, 17, 64, 65, 66, 300]))] for _ in range(120)]
    runs += [[1] * n for n in range(40)]
    want = [slow(r, ranks, made) for r in runs]
    assert [merge_all(list(r), ranks, made) for r in runs] == want
    size = np.array([len(r) for r in runs])
    every, left = Merges(ranks, made).of_runs(np.array([x for r in runs for x in r], dtype=np.int64), size)
    assert [x.tolist() for x in np.split(every, np.cumsum(left)[:-1])] == want


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def wanted(plain, texts):
    ids = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    return [(len(i), digest(" ".join(map(str, i))), digest(plain.decode(i, skip_special_tokens=False))) for i in ids]


def test_every_code_point(plain):
    points = [c for c in [*range(0x32000), *range(0xE0000, 0xE0200), 0xFFFFD, 0x10FFFD] if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 20_000):
        texts = ["{0} a{0}b1{0}".format(chr(c)) for c in points[at : at + 20_000]]
        assert list(zip(*TreeIds.at(FILE).report(pa.array(texts)))) == wanted(plain, texts)
        ids, ends = WordIds.at(FILE)(pa.array(texts), 1)
        want = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
        assert ids.tolist() == [x for w in want for x in [*w, 1]]


ODD = ["", " ", "\n\t", "Hello's 12,5 ÉTÉ don't!!", "a" * 30_000, "!?" * 3000, "x" * 5000 + "é" * 2000, "<|endoftext|>", "a<|startoftext|>b <|endoftext|><|endoftext|>\x1cc", "<|endoftext", "\x00\x1c\x85᠎﻿", "ab " * 20_000, "ﬀ ǅ Σς ΑΣ İ ı", "é ́", "👩‍👩‍👧 한국어 ภาษาไทย"]


@pytest.mark.parametrize("at_once", [1 << 18, 3])
def test_report(spark, plain, monkeypatch, at_once):
    monkeypatch.setattr(bpe, "WORDS_AT_ONCE", at_once)
    ids = TreeIds.at(FILE)
    got = list(zip(*ids.report(pa.array(ODD))))
    assert got == wanted(plain, ODD)
    assert [tuple(x[0] for x in ids.report(pa.array([t]))) for t in ODD] == got


def test_rows(spark, plain):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "a b"), (None, None), (3, "again"), (3, "again"), (99, None)]
    docs = spark.createDataFrame([(i, t, "k", 1, 2) for i, t in rows], SCHEMA).repartition(3)
    got = sorted(map(tuple, bpe.encoding_report(docs, FILE).collect()), key=str)
    assert got == sorted([(i, *w) for (i, _), w in zip(rows, wanted(plain, [t or "" for _, t in rows]))], key=str)
    ids = bpe.encoded(docs, FILE)
    back = sorted(map(tuple, bpe.decoded(ids, FILE).collect()), key=str)
    assert back == sorted([(i, plain.decode(plain.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)) for i, t in rows], key=str)
    crc = {(r.doc_id, r.piece): r.ids_crc32 for r in tokenized(docs.where("doc_id < 3"), FILE).collect()}
    assert crc == {(i, 0): zlib.crc32(np.array([*plain.encode(t, add_special_tokens=False).ids, 1], dtype="<u4").tobytes()) for i, t in enumerate(ODD[:3])}
    empty = bpe.encoding_report(docs.limit(0), FILE)
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert bpe.decoded(spark.createDataFrame([(1, None), (2, [5, 10**6])], "doc_id long, ids array<long>"), FILE).orderBy("doc_id").collect()[0].text is None
