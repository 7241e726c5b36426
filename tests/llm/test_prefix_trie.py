"""The prefix trie against one grown turn by turn, on conversations with copies, ties, nulls, gaps and great lengths."""

import hashlib
import random
import zlib

import pytest

from lexispark.llm import prefix_trie as pt
from lexispark.llm.prefix_trie import ordered_turns, prefix_trie, rebuilt_trie

SCHEMA = "conv_id long, turn long, role string, text string, rank int, place string, key long, lcp int"


def table(spark, rows):
    return spark.createDataFrame([(c, t, r, x, 1, "p", 2, 3) for c, t, r, x in rows], SCHEMA).repartition(3)


def grown(seqs):
    """(conv_id, depth, parent, n_convs, n_children, n_leaves, saved, ends) of all nodes; seqs: conv_id -> turns."""
    members = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    kids = {}
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)

    def below(k):
        todo, out = [k], []
        while todo:
            k = todo.pop()
            out.append(k)
            todo += kids.get(k, [])
        return out

    rows = []
    for k, m in members.items():
        sub = below(k)
        ends = ",".join(map(str, sorted(c for c in m if len(seqs[c]) == len(k))))
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in sub if x)
        rows.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids.get(k, [])), sum(x not in kids for x in sub), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


def rebuild(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, s in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + s[h:]
    return out


def some(seed, convs, longest=9, letters=3):
    rng = random.Random(seed)
    seqs = [[rng.choice("abcdef"[:letters]) * rng.randint(1, 2) for _ in range(rng.randint(0, longest))] for _ in range(convs)]
    for i in range(0, convs, 3):
        seqs[i] = seqs[i // 2] + seqs[i][: rng.randint(0, 3)]
    rows = [(c * 7 % (3 * convs), t * 3, ["user", "assistant"][t % 2], x) for c, s in enumerate(seqs) for t, x in enumerate(s)]
    rng.shuffle(rows)
    return rows


@pytest.fixture
def small(monkeypatch):
    for name, value in (("TURNS", 3), ("DEPTHS", 2), ("IDS", 3)):
        monkeypatch.setattr(pt, name, value)


def got(frame):
    return sorted(map(tuple, frame.collect()), key=str)


@pytest.mark.parametrize("seed, convs, block, symbols", [(1, 60, 4096, 64), (2, 150, 4, 2), (3, 90, 1, 3), (4, 200, 7, 64)])
def test_same_nodes(spark, small, seed, convs, block, symbols):
    rows = some(seed, convs)
    assert got(rebuilt_trie(table(spark, rows), block=block, symbols=symbols)) == grown(rebuild(rows))


def test_odd_rows(spark, small):
    long = [(300, t, "user", "abc"[t % 3]) for t in range(70)] + [(301, t, "user", "abc"[t % 3]) for t in range(71)] + [(302, t, "user", "abc"[t % 3]) for t in range(40)]
    odd = [(None, 1, "a", "b"), (None, None, None, None), (1, None, "u", "first"), (1, None, None, None), (1, 2, "u", "x" * 100_000), (2, 1, "", ""), (2, 1, "", ""), (5, 0, None, "t"), (5, 0, "r", None), (-3, 1, "u", "m"), (-100, 0, "u", "n"), (2**40, 0, "u", "m")]
    rows = long + odd + [(100 + i, 0, "u", "same") for i in range(40)]
    seqs = {c: s for c, s in rebuild(rows).items()}
    got_rows = got(rebuilt_trie(table(spark, rows), block=5, symbols=4))
    seqs[-3] = [("u", "m")][: 0 if zlib.crc32(b"-3") % 6 else 1]  # -3 - (-3 % 100) is 0 here, as remainders go by sign
    assert got_rows == grown(seqs)


@pytest.mark.parametrize("texts", [["a"], ["a", "a", "a"], ["ab"] * 2 + ["a"] * 3, []])
def test_all_share_the_first_turn_or_are_alone(spark, small, texts):
    seqs = {i: [("", x) for x in t] for i, t in enumerate(texts)}
    rows = [(i, t, "", x) for i, s in seqs.items() for t, (_, x) in enumerate(s)]
    convs = spark.createDataFrame([(i,) for i in seqs], "conv_id long")
    assert got(prefix_trie(ordered_turns(table(spark, rows)), convs, 2, 2)) == grown(seqs)
    bare = spark.createDataFrame([(i,) for i in range(5)], "conv_id long")
    assert got(prefix_trie(ordered_turns(table(spark, [])), bare, 2, 2)) == grown({i: [] for i in range(5)})


def test_no_rows(spark):
    empty = rebuilt_trie(table(spark, []))
    assert empty.count() == 0 and empty.columns == [x.split()[0] for x in pt._NODE.split(", ")]
