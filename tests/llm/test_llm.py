"""Operators of this subpackage against brute force, on small inputs with nulls, empty and very long texts, ties,
repeated rows, empty tables and extra columns."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, length long, size int, key string"


def docs(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), 1, 2, "k") for i, t, s in rows], DOCS).repartition(3)


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"]) + str(rng.randint(0, 40)) for _ in range(n))


def corpus(seed=1, n=40):
    rng = random.Random(seed)
    texts = [words(rng, rng.randint(3, 80)) for _ in range(n)]
    shared = words(rng, 20)
    for i in range(0, n, 5):
        texts[i] = texts[i] + "\n" + shared + "\n" + texts[(i + 1) % n][:30]
    texts[3] = texts[7]
    texts[11] = texts[12][:-1] + "é"
    rows = [(i * 3, t, f"s{i % 4}") for i, t in enumerate(texts)]
    return rows + [(1000, None, None), (1001, "", "s1"), (1002, "x", None), (1003, "ab " * 6000, "s0"), (1004, "a" * 400, "s0"), (1005, "a" * 300, "s2")]


# 1 ---------------------------------------------------------------------------------------------------------------------


def removed(rows, least=50):
    first = {}
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (t or "").encode()
        for p in range(len(raw) - least + 1):
            first.setdefault(raw[p : p + least], i)
    out = []
    for i, t, _ in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - least + 1):
            low = first[raw[p : p + least]]
            if low != i and (i is None or low < i):
                gone[p : p + least] = b"\x01" * least
        runs = sum(1 for k in range(len(raw)) if gone[k] and (not k or not gone[k - 1]))
        out.append((i, len(raw), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(raw, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


# one chunk and bucket; several of both, with texts longer than a chunk; every key hot
REPEATS = [{}, {"chunk": 700, "a_bucket": 1500}, {"chunk": 2000, "a_bucket": 3000, "hot": 1}, {"hot": 3}]


@pytest.mark.parametrize("sizes", REPEATS)
def test_repeats_match_brute_force(spark, sizes):
    from lexispark.llm import repeats

    rows = corpus() + [(None, "z" * 10 + corpus()[3][1], "s1"), (9, corpus()[3][1], "s1")]
    rng, passage = random.Random(3), words(random.Random(4), 9)
    rows += [(2000 + i, f"{words(rng, 6)} {passage} {words(rng, 6)}", "s") for i in range(30)]  # one passage in many surroundings
    got = sorted((tuple(r) for r in repeats.repeat_report(docs(spark, rows), **sizes).collect()), key=str)
    assert got == removed(rows)
    if sizes.get("chunk") == 700:
        return
    kept = {r.doc_id: bytes(r.kept) for r in repeats.without_repeats(docs(spark, rows), **sizes).collect() if r.doc_id not in (9, None)}
    assert all(hashlib.sha256(kept[i]).hexdigest() == h for i, _, _, _, h in got if i in kept)
    assert repeats.repeat_report(docs(spark, rows).limit(0), **sizes).count() == 0


@pytest.mark.parametrize("sizes", [{}, {"chunk": 1500, "a_bucket": 3000, "hot": 2}])
def test_repeat_groups_have_all_occurrences(spark, sizes):
    from lexispark.llm import repeats

    rows = corpus(2, 25)
    raw = {i: (t or "").encode() for i, t, _ in rows}
    groups = {}
    for r in repeats.repeat_groups(docs(spark, rows), **sizes).collect():
        groups.setdefault(r.group, set()).add((r.doc_id, r.start, r.length))
    want = {}
    for i, text in raw.items():
        for a in range(len(text) - 49):
            want.setdefault(text[a : a + 50], set()).add((i, a))
    covered = {}
    for where in groups.values():
        strings = {raw[i][a : a + n] for i, a, n in where}
        assert len(strings) == 1 and len(where) > 1 and len({n for *_, n in where}) == 1 and min(n for *_, n in where) >= 50
        for i, a, n in where:
            for k in range(n - 49):
                covered.setdefault(raw[i][a + k : a + k + 50], set()).add((i, a + k))
    for string, where in want.items():
        if len({i for i, _ in where}) > 1:
            assert where <= covered.get(string, set())
    assert repeats.repeat_groups(docs(spark, rows).limit(0), **sizes).count() == 0


def test_maximal_repeats_match_brute_force():
    from lexispark.llm import repeats

    rng = random.Random(4)
    pieces = ["".join(rng.choice("ab") for _ in range(rng.randint(16, 40))) for _ in range(30)]
    pieces[5:9] = [pieces[4][3:] + "abba", "ba" + pieces[4][3:], pieces[4][:20], "a" * 33]
    body, start = b"", []
    for p in pieces:
        start.append(len(body))
        body += p.encode() + b"\xff"
    text, start, length = np.frombuffer(body, np.uint8), np.array(start), np.array([len(p) for p in pieces])
    group, piece, place, size, least = repeats.maximal_repeats(text, start, length, np.arange(len(pieces)), 16)
    got = set()
    for g in set(group.tolist()):
        at = group == g
        got.add((body[place[at][0] : place[at][0] + size[at][0]], frozenset(zip(piece[at].tolist(), (place[at] - start[piece[at]]).tolist()))))
    want = {}
    for i, p in enumerate(pieces):
        for a in range(len(p)):
            for z in range(a + 16, len(p) + 1):
                want.setdefault(p[a:z], set()).add((i, a))
    full = set()
    for s, where in want.items():
        left = {pieces[i][a - 1] if a else (i, a) for i, a in where}
        right = {pieces[i][a + len(s)] if a + len(s) < len(pieces[i]) else (i, a) for i, a in where}
        if len(where) > 1 and len(left) > 1 and len(right) > 1:
            full.add((s.encode(), frozenset(where)))
    assert full <= got
    assert all(len({pieces[i][a - 1] if a else (i, a) for i, a in w}) > 1 and all(pieces[i][a : a + len(s)].encode() == s for i, a in w) for s, w in got)


# 2 ---------------------------------------------------------------------------------------------------------------------


def slow_perspectives(rows):
    """All dialogues from all sides, by plain loops over (conv_id, turn, speaker, text)."""
    rows = [(c, t, "unknown" if s is None else s, x or "") for c, t, s, x in rows]
    out = Counter()
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, hashlib.md5(f"{r[2]}\x00{r[3]}".encode()).hexdigest()))
        for viewer in {r[2] for r in own}:
            at = 0
            for place, (_, turn, speaker, text) in enumerate(own):
                mine = speaker == viewer
                head = "<|assistant|>\n" if mine else f"<|user {speaker}|>\n"
                rendered = f"{head}{text}<|end|>\n"
                masks = (at + len(head), at + len(rendered) - 1) if mine else (at, at)
                out[conv, viewer, turn, place, "assistant" if mine else "user", None if mine else speaker, rendered, int(mine), at, at + len(rendered), *masks] += 1
                at += len(rendered)
    return out


@pytest.mark.parametrize("bucket", [1000, 3, 1])
def test_perspectives(spark, bucket):
    from lexispark.llm.dialogues import dialogues, perspectives

    rng = random.Random(12)
    rows = [(1, 0, "user", "hi"), (1, 1, "bot", "yo"), (1, 1, "bot", "yo"), (2, None, None, None), (None, 3, "a", "b"), (None, 3, "c", ""), (None, None, "a", "b")]
    rows += [(3, i % 9, rng.choice(["a", "é🙂", None, "unknown"]), words(rng, rng.randint(0, 5))) for i in range(40)]
    rows += [(4, 7, rng.choice("ab"), f"all at once {i % 30}") for i in range(50)] + [(4, 2, "a", "x" * 50_000), (4, 9, "b", "last"), (4, -5, "b", "first")]
    d = spark.createDataFrame([(*r, 5, "own", "own") for r in rows], "conv_id long, turn long, role string, text string, place int, digest string, bucket string")
    assert Counter(tuple(r) for r in perspectives(d, turns_a_bucket=bucket).collect()) == slow_perspectives(rows)
    got = {(r.conv_id, r.viewer): r for r in dialogues(d.where("conv_id in (1, 2)"), turns_a_bucket=bucket).collect()}
    bot = got[1, "bot"]
    assert bot.text == "<|user user|>\nhi<|end|>\n" + "<|assistant|>\nyo<|end|>\n" * 2
    assert [bot.text[m.mask_start : m.mask_end] for m in bot.masks] == ["yo<|end|>"] * 2
    assert got[2, "unknown"].text == "<|assistant|>\n<|end|>\n"
    assert perspectives(d.limit(0)).count() == 0


# 3 ---------------------------------------------------------------------------------------------------------------------


def test_fingerprints(spark):
    from lexispark.llm import fingerprints as fp

    rows = corpus()
    got = {r.doc_id: r for r in fp.fingerprint_report(docs(spark, rows)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    assert len(got) == len(rows)
    for i, (doc, text, _) in enumerate(order):
        after = order[(i + 1) % len(order)][1] or ""
        text = text or ""
        changed = fp.edited(text, after)
        r = got[doc]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert r.fingerprint == fp.fingerprint(text).astype(">u2").tobytes().hex()
        assert r.near_edited == fp.likeness(fp.fingerprint(text), fp.fingerprint(changed))
        assert r.near_next == fp.likeness(fp.fingerprint(text), fp.fingerprint(after))
    assert got[1000].fingerprint == got[1001].fingerprint
    assert fp.fingerprint_report(docs(spark, rows).limit(0)).count() == 0
    one = fp.fingerprint_report(docs(spark, [(5, "a b c", "s")])).collect()
    assert [r.near_next for r in one] == [1.0]
    assert fp.fingerprint_report(docs(spark, [(5, "a b c", "s"), (5, "a b c", "s"), (None, "q", None), (5, "d", "s")])).count() == 4


def test_fingerprints_by_many_ranges(spark):
    from lexispark.llm import fingerprints as fp

    rows = corpus(2, 60) + [(None, f"no id {i} " * 5, "s") for i in range(20)] + [(9, f"again {i}", "s") for i in range(10)]
    one, many = ([tuple(r) for r in fp.fingerprint_report(docs(spark, rows), ranges=n).collect()] for n in (1, 300))
    assert len(one) == len(rows) and Counter(one) == Counter(many)


def test_collisions_follow_generalised_jaccard():
    from lexispark.llm import fingerprints as fp

    rng, off = random.Random(2), []
    for _ in range(120):
        a = Counter({f"w{rng.randint(0, 30)}": rng.randint(1, 9) for _ in range(25)})
        b = Counter({k: v if rng.random() < 0.6 else rng.randint(1, 9) for k, v in a.items() if rng.random() < 0.8})
        both = set(a) | set(b)
        true = sum(min(a[k], b[k]) * len(k) for k in both) / sum(max(a[k], b[k]) * len(k) for k in both)
        off.append(fp.likeness(fp.Sampler()(a), fp.Sampler()(b)) - true)
    assert abs(np.mean(off)) < 0.015 and np.std(off) < 0.06


# 4 ---------------------------------------------------------------------------------------------------------------------


def toxic_rows(n=900, seed=3):
    rng = random.Random(seed)
    rows, marks = [], []
    for i in range(n):
        w = words(rng, rng.randint(5, 60)).split()
        bad = rng.random() < 0.25
        if bad:
            at = rng.randrange(len(w))
            w[at] = rng.choice(["idiot", "1d1ot", "IDIOT", "sсum", "scum"])  # the fourth has a Cyrillic letter
        elif rng.random() < 0.2:
            w[1:1] = ["village", "idiot"]
        rows.append((i, " ".join(w), "s"))
        marks.append((i, 1, int(bad)))
    return rows, marks


def test_toxicity(spark):
    from lexispark.llm import toxicity as tox

    rows, marks = toxic_rows()
    d, labels = docs(spark, rows + [(None, None, None), (5000, "", "s"), (5001, "x " * 9000, "s"), (1, rows[1][1], "s")]), spark.createDataFrame(marks + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    lexicon = tox.fit(d, tox.train_labels(labels))
    got = tox.scored(d, lexicon).collect()
    assert len(got) == len(rows) + 4
    truth = {i: t for i, _, t in marks}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert "village idiot" in {p.replace("viiiage", "village") for p in lexicon.exceptions}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert tox.without_toxic(d, lexicon).columns == d.columns
    empty = tox.fit(d.limit(0), labels)
    assert empty.weights == {} and tox.scored(d.limit(0), empty).count() == 0


# 5 ---------------------------------------------------------------------------------------------------------------------


def shingle_set(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def linked_groups(rows, percent=80):
    sets = [shingle_set(t) for _, t, _ in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (doc, _, _) in enumerate(rows):
        least[root(i)] = min(doc, least.get(root(i), doc))
    return {(doc, len(sets[i]), least[root(i)], doc == least[root(i)]) for i, (doc, _, _) in enumerate(rows)}


@pytest.mark.parametrize("long", [64, 3])
def test_near_duplicates(spark, monkeypatch, long):
    from lexispark.llm import near_dups

    monkeypatch.setattr(near_dups, "LONG", long)  # with 3 most lists take the way of long ones
    rng, rows = random.Random(5), corpus(6)
    base = words(rng, 150).split()
    for i in range(25):  # a group of near copies, some of them only by way of others
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"new{rng.randint(0, 999)}"
        rows.append((2000 + i, " ".join(w).upper() if i % 2 else " ".join(w), "s"))
        base = w if i % 3 == 0 else base
    got = near_dups.near_duplicates(docs(spark, rows)).drop("tkey")
    assert {tuple(r) for r in got.collect()} == linked_groups(rows)
    left = near_dups.without_near_duplicates(docs(spark, rows + rows[:3]))
    assert {r.doc_id for r in left.collect()} == {d for d, _, c, k in linked_groups(rows) if k} and left.count() == sum(k for *_, k in linked_groups(rows))
    assert near_dups.near_duplicates(docs(spark, rows).limit(0)).count() == 0


def test_near_duplicates_at_half(spark):
    from lexispark.llm import near_dups

    rng, rows = random.Random(6), []
    for i in range(60):  # pairs whose sets share a little over half
        w = [f"p{i}w{k}" for k in range(rng.randint(60, 200))]
        at = len(w) * 18 // 25
        rows += [(2 * i, " ".join(w), "s"), (2 * i + 1, " ".join(w[:at] + [f"q{i}w{k}" for k in range(len(w) - at)]), "s")]
    got = near_dups.near_duplicates(docs(spark, rows), percent=50).drop("tkey")
    assert {tuple(r) for r in got.collect()} == linked_groups(rows, 50)
    assert sum(not k for *_, k in linked_groups(rows, 50)) > 50


def test_near_duplicates_of_stock_paragraphs(spark, monkeypatch):
    from lexispark.llm import near_dups

    rng = random.Random(16)
    stock = [words(rng, 40) for _ in range(12)]
    rows = [(i, " ".join(rng.sample(stock, rng.randint(2, 6))), "s") for i in range(150)]
    rows += [(1000 + i, rows[i][1] + " tail", "s") for i in range(0, 150, 3)]
    seen = []
    near = near_dups._estimated
    monkeypatch.setattr(near_dups, "_estimated", lambda pairs, *a: (seen.append(pairs.count()), near(pairs, *a))[1])
    got = near_dups.near_duplicates(docs(spark, rows), percent=85).drop("tkey")
    assert {tuple(r) for r in got.collect()} == linked_groups(rows, 85)
    assert sum(seen) < 10 * len(rows)


def test_copies_without_ids(spark):
    from lexispark.llm import near_dups

    rng = random.Random(7)
    a, b, c = (words(rng, 60) for _ in range(3))
    rows = [(None, a, "s"), (None, a + " x", "s"), (None, a, "s"), (None, b, "s"), (5, b + " y", "s"), (None, None, "s"), (None, c, "s")]
    d = docs(spark, rows).withColumn("row", F.lit("own")).withColumn("d_key", F.lit("mine")).withColumn("r_doc", F.lit("x"))
    left = near_dups.without_near_duplicates(d)
    assert left.columns == d.columns and all((r.row, r.d_key, r.r_doc) == ("own", "mine", "x") for r in left.collect())
    texts = Counter(r.text for r in left.collect())
    assert texts[a] + texts[a + " x"] == 1 and texts == Counter([t for t in (a, a + " x") if texts[t]] + [b + " y", None, c])


@pytest.mark.parametrize("n", [50, 400])
def test_near_duplicates_between_80_and_85(spark, n):
    from corpus_pipeline import drop_near_duplicates
    from lexispark.llm import near_dups

    w = [f"w{i}" for i in range(n + 4)]
    cut = n - round(0.82 * n)
    rows = [(1, " ".join(w), "s"), (2, " ".join(w[:-cut]), "s"), (3, " ".join(w[: -2 * cut]), "s")]
    sets = [shingle_set(t) for _, t, _ in rows]
    assert 0.8 <= len(sets[1]) / len(sets[0]) < 0.85 and len(sets[2]) / len(sets[1]) < 0.8
    left = drop_near_duplicates(spark, docs(spark, rows), None)
    assert sorted(r.doc_id for r in left.collect()) == [1, 3]
    assert {tuple(r) for r in near_dups.near_duplicates(docs(spark, rows), percent=85).drop("tkey").collect()} == linked_groups(rows, 85)
    assert (near_dups.shared(85), near_dups.first_values(85)) == (32, 16)


@pytest.mark.parametrize("at_once", [None, 0])
def test_components(spark, at_once):
    from lexispark.llm.common import components

    chain = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long"), at_once=at_once).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}


# 6 ---------------------------------------------------------------------------------------------------------------------


def test_urls(spark):
    from lexispark.llm.urls import judged

    rng = random.Random(1)
    urls = [f"https://{rng.choice(['a', 'www.b', 'm.c'])}.com/{rng.choice(['news', 'blog'])}/{rng.randint(1, 99)}" for _ in range(300)]
    urls += [f"http://x{rng.randint(1, 9)}.net/es/casino-{rng.randint(1, 99)}" for _ in range(300)]
    fixed = [None, "", "no scheme", "HTTP://EXAMPLE.com/en/1?q", "http://www.Example.com/en/1#t", "http://blog.www.example.com/en/", "http://example.com/de/", "http://badexample.com/en/1", "http://a.net/fr/x", "http://a.net/frx", "http://com", "http://x.org?a=/b", "http://y.org/es/casino-7", "http://z.org/news/7"]
    rows = [(i, u, "") for i, u in enumerate(fixed + urls)]
    got = {r.page_id: r for r in judged(spark.createDataFrame(rows, "page_id long, url string, rule string")).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(len(fixed))] == [
        ("", "", None), ("", "", None), ("", "", None), ("example.com", "/en/1", "example.com/en/"), ("www.example.com", "/en/1", "www.example.com/en/"),
        ("blog.www.example.com", "/en/", "www.example.com/en/"), ("example.com", "/de/", "com/"), ("badexample.com", "/en/1", "com/"), ("a.net", "/fr/x", "net/fr/"),
        ("a.net", "/frx", None), ("com", "", None), ("x.org", "", None), ("y.org", "/es/casino-7", None), ("z.org", "/news/7", None),
    ]
    assert got[12].verdict == "block" and got[13].verdict == "allow" and got[12].score < got[13].score
    empty = spark.createDataFrame([], "page_id long, url string")
    assert judged(empty).count() == 0


def test_odd_urls(spark):
    from lexispark.llm.urls import judged

    rows = [(1, "http://a.com/x", 0), (1, "http://a.com/x", 0), (None, "http://a.net/es/y", 0), (2, "http://a.net/es/y", 0), (3, "http://b.org/" + "é" * 20_000, 0), (4, None, 0), (5, "", 0)] + [(9, "http://c.org/", 0)] * 50
    got = judged(spark.createDataFrame(rows, "page_id long, url string, score int").repartition(3)).collect()
    assert Counter(r.page_id for r in got) == Counter(i for i, *_ in rows)
    assert len({(r.score, r.verdict) for r in got if r.page_id in (4, 5)}) == 1 and len({r.score for r in got if r.page_id == 9}) == 1
    only = judged(spark.createDataFrame(rows[:2] + rows[-1:], "page_id long, url string, score int")).collect()
    assert {r.verdict for r in only} == {"allow"}  # no rule blocks any


def test_url_scores_by_slow_counting(spark):
    from lexispark.llm import urls

    rng = random.Random(21)
    texts = [f"http://{rng.choice('abc')}.{rng.choice(['com', 'org'])}/{rng.choice(['news', 'casino', 'é'])}/{rng.randint(1, 60)}" for _ in range(200)]
    rows = [(t, None if i % 3 == 0 else int("casino" in t)) for i, t in enumerate(dict.fromkeys(texts))] + [("", None)]
    d = spark.createDataFrame(rows + rows[:40], "url string, side int")
    distinct = urls.distinct_urls(d, a_part=20).cache()
    learned = [(r.url, r.side, r.n) for r in distinct.where(~urls.held_out()).collect() if r.side is not None]
    got = {r.s_url: r.score for r in urls.scores(distinct, urls.counted(distinct.where(~urls.held_out()))).collect()}
    raw = lambda u: b"\x00" * 5 + u.encode() + b"\x03"

    def chance(side, before, byte):
        p = 1 / 256
        for k in range(6):
            context = before[len(before) - k :]
            seen = hits = 0
            for u, s, n in learned:
                text = raw(u)
                for i in range(5, len(text)):
                    if s == side and text[i - k : i] == context:
                        seen += n
                        hits += n * (text[i] == byte)
            p = (hits + 2.0 * p) / (seen + 2.0)
        return p

    assert set(got) == {u for u, _ in rows}
    for url in [rows[0][0], rows[7][0], ""]:
        text = raw(url)
        logs = [math.log(chance(0, text[i - 5 : i], text[i]) / chance(1, text[i - 5 : i], text[i])) for i in range(5, len(text))]
        assert abs(got[url] - sum(logs) / len(logs)) < 1e-9


def test_held_out_urls_are_judged_well(spark):
    from lexispark.llm import urls

    rng = random.Random(22)
    good, bad = ["news", "blog", "wiki", "science"], ["casino", "win", "bonus", "poker"]
    rows = []
    for i in range(1500):
        side = int(rng.random() < 0.4)
        w = bad if side else good
        rows.append((f"https://{rng.choice('abcdef')}{rng.randint(1, 40)}.org/{rng.choice(w)}/{rng.choice(w)}-{rng.randint(1, 999)}", side))
    d = spark.createDataFrame(rows, "url string, side int")
    distinct = urls.distinct_urls(d, a_part=200)
    test = distinct.where(urls.held_out()).join(urls.scores(distinct, urls.counted(distinct.where(~urls.held_out()))), F.col("url") == F.col("s_url"))
    cut = urls.threshold(test.select("side", "n", "score"))
    found = test.select("side", "score").collect()
    assert len(found) > 200 and np.mean([(r.score < cut) == bool(r.side) for r in found]) > 0.98


# 7 ---------------------------------------------------------------------------------------------------------------------


def test_mixing(spark):
    from lexispark.llm.mixing import mix_report, mix_rows

    rows = corpus(7, 200)
    rows.append(rows[0])
    for bucket in (50_000, 10):
        got = mix_report(docs(spark, rows), rows_a_bucket=bucket).collect()
        assert len(got) == len(rows)
        total = sum(r["size"] for r in got)
        names = sorted({r.source for r in got}, key=lambda s: (s is None, s or ""))
        size = {s: sum(r["size"] for r in got if r.source == s) for s in names}
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
        low, high = 0.0, float(2 * total)
        for _ in range(200):  # the level at which all shares sum to the whole
            mid = (low + high) / 2
            low, high = (mid, high) if sum(min(2 * size[s], mid * weight[s]) for s in names) < 1.5 * total else (low, mid)
        for r in got:
            assert abs(r.target - min(2 * size[r.source], high * weight[r.source])) < 1e-3 and r.source_size == size[r.source]
            assert r.taken in (0, r["size"], 2 * r["size"]) and (r.position is None) == (r.taken == 0)
        for s in names:
            taken = sum(r.taken for r in got if r.source == s)
            assert abs(taken - min(2 * size[s], high * weight[s])) <= max((r["size"] for r in got if r.source == s), default=0) / 2
        assert [tuple(r) for r in mix_report(docs(spark, rows), rows_a_bucket=bucket).collect()] == [tuple(r) for r in got]
    at = [r.position for r in got if r.position is not None]
    assert at == sorted(at) and 0 <= at[0] and at[-1] <= 1
    mixed = mix_rows(docs(spark, rows))
    assert mixed.columns == docs(spark, rows).columns
    want = Counter()
    for r in got:
        want[r.doc_id] += r.times
    assert Counter(r.doc_id for r in mixed.collect()) == +want
    assert mix_report(docs(spark, rows).limit(0)).count() == 0 and mix_rows(docs(spark, rows).limit(0)).count() == 0


def test_mixing_of_equal_rows(spark):
    from lexispark.llm.mixing import mix_report, mix_rows

    rows = [(1, "one two three", "a")] * 7 + [(2, "four five", "a")] * 2 + [(None, "six", None)] * 3 + [(3, "seven eight nine ten", "b")]
    d = docs(spark, rows).withColumn("m_k", F.lit("kept")).withColumn("row", F.lit(1)).withColumn("m_doc_id", F.lit("x"))
    want = Counter()
    for r in mix_report(d).collect():
        want[r.doc_id] += r.times
    for _ in range(2):
        got = mix_rows(d).collect()
        assert Counter(r.doc_id for r in got) == +want and all((r.m_k, r.row, r.m_doc_id) == ("kept", 1, "x") for r in got)


def test_sources_are_ranked_by_code_point(spark):
    from lexispark.llm.mixing import ranked_sources

    names = ["", "a", "https://b", "https://a", "http", "é", "z", "\U0001f642", "\uffee", None, *(f"https://x{i}" for i in range(50))]
    got = ranked_sources(spark.createDataFrame([(n,) for n in names], "source string"), a_range=9).collect()
    assert [r.source for r in sorted(got, key=lambda r: r.turn)] == sorted(filter(lambda n: n is not None, names)) + [None]
    assert sorted(r.turn for r in got) == list(range(len(names)))


def test_positions_by_slow_summation(spark):
    from lexispark.llm.mixing import SCHEDULES, mix_report

    got = mix_report(docs(spark, corpus(17, 90))).collect()
    names = sorted({r.source for r in got}, key=lambda s: (s is None, s or ""))
    times = np.linspace(0, 1, 20001)
    for i, s in enumerate(names):
        factor = np.interp(times, *zip(*SCHEDULES[i % 3]))
        done = np.concatenate([[0], np.cumsum((factor[1:] + factor[:-1]) / 2) / 20000])
        taken = sorted((r for r in got if r.source == s and r.taken), key=lambda r: r.position)
        before = 0
        for r in taken:  # those taken once more at the end come a second time after the whole source
            if r.position is not None and before <= taken[0].target:
                assert abs(np.interp(r.position, times, done) * r.target - before) < max(2, 0.002 * r.target) or r.times < taken[0].times
            before += r["size"]


# 8 ---------------------------------------------------------------------------------------------------------------------


def item_by_item(lengths, capacity):
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, x in enumerate(left) if x >= n]
        if fits:
            left[min(fits, key=lambda i: left[i])] -= n
        else:
            left.append(capacity - n)
    return len(left)


def test_plan_is_best_fit():
    from lexispark.llm.packing import plan

    rng = random.Random(8)
    for _ in range(60):
        capacity = rng.randint(5, 40)
        counts = Counter(rng.randint(1, capacity) for _ in range(rng.randint(0, 300)))
        used, number = Counter(), Counter()
        for length, rank, n, first, each, offset in plan(counts, capacity):
            assert rank == number[length] or not n
            number[length] += n
            for k in range(n):
                assert used[first + k // each] == offset + k % each * length
                used[first + k // each] += length
        assert number == counts and max(used.values(), default=0) <= capacity
        assert len(used) == item_by_item(counts.elements(), capacity)


def test_packing(spark):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    from lexispark.llm import packing

    file = public.path("word_bpe_49k.json")
    plain = tokenizers.Tokenizer.from_file(file)
    odd = ["ΣΑΣ İs don't we'll 'thing '''s", "a\x1cb c\x85d​e f", "été ́x x́", "½ ② x² 日本語 🙂🙂", "<|endoftext|>", "a<|startoftext|>b <|endoftext|>\x1d<|ENDOFTEXT|>", "\x00a\x01.b \x7f rock'n'roll it's. 12ab3,c", " \n "]
    rows = corpus(8) + [(3000 + i, t, "s") for i, t in enumerate(odd)] + [(3000, odd[0], "s"), (None, "tail", "s")]
    for bucket in (50_000, 3):
        pieces = packing.stored(packing.tokenized(docs(spark, rows), file), "pieces")
        got = packing.packed(pieces, rows_a_bucket=bucket).collect()
        want = Counter()
        for doc, text, _ in rows:
            ids = plain.encode(text or "", add_special_tokens=False).ids + [1]
            for k in range(0, len(ids), 4096):
                part = ids[k : k + 4096]
                want[doc, k // 4096, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
        ends = Counter()
        for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
            assert r.offset == ends[r.sequence_id]
            ends[r.sequence_id] += r.length
        assert max(ends.values()) <= 4096 and len(ends) == item_by_item([r.length for r in got], 4096)
    assert packing.pack_documents(docs(spark, rows).limit(0), file).count() == 0


# 9 ---------------------------------------------------------------------------------------------------------------------


def base_spans(text):
    import re

    forms = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def fits(kind, s):
        d = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(x) <= 255 for x in s.split("."))
        if kind == "card":
            return 16 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
        return kind != "phone" or 8 <= len(d) <= 15

    return [(k, m.start(), m.end()) for k, f in forms.items() for m in re.finditer(f, text) if fits(k, m.group())]


HARD = [
    "a@b.c_d@e.f @x.y a@@b.c a.b+c@d-e.f.g, q@r", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.4 1.2.3 0000255.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111111 0000000000000000",
    "+1 (262) 555-3752 +1.2 ++44 20 7946 0958) +123456789012345678", "ünï@ä.ö é 🙂 mail me@here.org 🙂 10.0.0.1", "9" * 50_000, "1 " * 20_000, "a" * 60_000 + "@b.c", "@" * 5000, "", None, "+" + "1" * 40_000,
]


def test_personal_data(spark):
    from lexispark.llm.personal import KINDS, personal_report, redacted

    rows = [(i, t, "s") for i, t in enumerate(HARD)] + [(0, HARD[0], "s"), (None, HARD[1], None)]
    got = personal_report(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = (HARD[1] if r.doc_id is None else HARD[r.doc_id]) or ""
        spans = base_spans(text)
        said = ",".join(f"{k}:{a}:{z}" for k, a, z in spans)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest() and r.spans == said
        assert [r[f"n_{k}"] for k in KINDS] == [sum(s[0] == k for s in spans) for k in KINDS]
    new = {r.doc_id: r.text for r in redacted(docs(spark, rows)).collect()}
    assert new[4] == "ünï@ä.ö é 🙂 mail [EMAIL] 🙂 [IP]" and new[10] is None and new[6] == HARD[6]
    assert redacted(docs(spark, rows)).count() == len(rows) and redacted(docs(spark, rows)).columns == docs(spark, rows).columns
    assert personal_report(docs(spark, rows).limit(0)).count() == 0


def test_patterns_find_more(spark):
    from lexispark.llm.personal import personal_report

    rng = random.Random(9)
    rows = [(i, f"{words(rng, 5)} telephone +1 262 555 {1000 + i} {words(rng, 4)} code {rng.randint(10**7, 10**8)}", "s") for i in range(30)]
    rows = [(i, t.replace("+1 262 555 ", "+1262555"), s) for i, t, s in rows] + [(100, "call telephone 2625551234 now", "s"), (101, "my code 2625551234 now", "s")]
    got = {r.doc_id: r.spans for r in personal_report(docs(spark, rows)).collect()}
    assert got[100] == "phone:15:25" and got[101] == ""


def test_patterns_of_several_groups(spark):
    from lexispark.llm.personal import personal_report

    rng = random.Random(19)

    def card():
        head = [rng.randint(1, 9) for _ in range(15)]
        odd = sum(sum(divmod(2 * d, 10)) for d in head[::2]) + sum(head[1::2])
        digits = "".join(map(str, [*head, -odd % 10]))
        return " ".join(digits[i : i + 4] for i in range(0, 16, 4))

    rows = [(i, f"{words(rng, 5)} telephone +1 ({262 + i}) 555-{1000 + i} {words(rng, 4)} code {rng.randint(10**7, 10**8)} visa {card()}, {words(rng, 3)}", "s") for i in range(30)]
    more = {100: ("call telephone (262) 555-1234 now", "phone:15:29"), 101: ("my code (262) 555-1234 now", ""), 102: ("a telephone: 262 555 1234, or", "phone:13:25"), 103: ("the visa 4111 1111 1111 1112.", "card:9:28"), 104: ("no telephone 2625551234 12 times", "phone:13:23"), 105: ("telephone 12 or 14", ""), 106: ("é telephone (262 555 1234)", "phone:13:25")}
    got = {r.doc_id: r.spans for r in personal_report(docs(spark, rows + [(i, t, "s") for i, (t, _) in more.items()])).collect()}
    assert {i: got[i] for i in more} == {i: spans for i, (_, spans) in more.items()}


# 10 --------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("a_cell", [8192, 40])
def test_vectors(spark, a_cell):
    from lexispark.llm.vectors import unit, vector_components

    rng = np.random.default_rng(10)
    base = rng.standard_normal((120, 24))
    near = base[:40] + 0.05 * rng.standard_normal((40, 24))
    chain = [base[0] + 0.12 * k * base[1] for k in range(12)]
    rows = [(i * 2, v.tolist()) for i, v in enumerate([*base, *near, *chain])]
    rows += [(900 + i, rows[5][1]) for i in range(30)] + [(1000, [x * 2 for x in rows[6][1]]), (1001, None), (1002, [0.0] * 24), (1003, [math.nan] * 24), (1004, [None] * 24), (1005, [1.0, 2.0]), (1006, [1.0, 2.0]), (1007, []), (1008, [math.inf] + [1.0] * 23), (1009, [1e200] * 24), (1010, [1e-200] * 24)]
    # repeated ids, with equal and with other vectors, and rows without one
    rows += [(10, rows[5][1]), (20, rows[30][1]), (20, (-np.array(rows[31][1])).tolist()), (None, rows[5][1]), (None, rows[6][1]), (None, None)]
    d = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], "vec_id long, embedding array<double>, unit string, node int, copies int")
    got = Counter(tuple(r) for r in vector_components(d, a_cell=a_cell).collect())
    units = [None if i is None else unit(v) for i, v in rows]
    links = [[j for j, u in enumerate(units) if j != k and own is not None and u is not None and len(u) == len(own) and u @ own >= 0.95] for k, own in enumerate(units)]
    want = Counter()
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        low = None if i is None else min(rows[j][0] for j in seen)
        want[i, len(links[k]), low, i is None or i == low] += 1
    assert got == want
    assert vector_components(d.limit(0)).count() == 0 and vector_components(d.where("vec_id in (1001, 1002)")).count() == 2


# Pipeline ----------------------------------------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    rows, marks = toxic_rows(300)
    rows = [(i, t, f"s{i % 3}") for i, t, _ in rows] + [(5000, rows[10][1], "s0"), (5001, "write to me@here.org please, dear reader of this text", "s1"), (5002, None, None), (5003, "", "s1")]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.columns
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out{i}")
        docs = spark.read.parquet(f"{tmp_path}/out{i}")
        seen.append(docs)
        assert docs.columns == before or i == 4
    toxic, single, private, mixed, packed = seen
    bad = {i for i, _, t in marks if t}
    left = {r.doc_id for r in toxic.collect()}
    assert len(left & bad) < 0.05 * len(bad) and len({i for i, _, _ in rows} - bad - left) == 0
    assert 5000 not in {r.doc_id for r in single.collect()} or 10 not in left
    assert {r.text for r in private.where("doc_id = 5001").collect()} == {"write to [EMAIL] please, dear reader of this text"}
    assert private.count() == single.count() and mixed.count() >= single.where("size(split(text, ' ')) > 0 and text <> ''").count() * 0.5
    assert packed.count() >= mixed.count()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == packed.count()


def test_pipeline_against_plain_loops(spark, tmp_path):
    import re

    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    import corpus_pipeline
    from lexispark.llm.mixing import mix_report
    from lexispark.llm.toxicity import fit, train_labels

    rng = random.Random(31)
    rows, marks = toxic_rows(400, seed=8)
    rows = [(i, t, f"s{i % 3}") for i, t, _ in rows]
    for k in range(20):  # copies, near copies, personal data, further rows
        i, t, s = rows[rng.randrange(300)]
        rows += [(5000 + 3 * k, t, s), (5001 + 3 * k, t + " end", s), (5002 + 3 * k, f"{words(rng, 30)} mail u{k}@here.org from 10.0.0.{k}", "s9")]
    rows += [(9000, None, None), (9001, "", "s1"), rows[0]]
    d = docs(spark, rows).withColumn("row", F.lit("mine")).withColumn("m_key", F.lit(1)).withColumn("r_text", F.lit("x"))
    d.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    lexicon = fit(d, train_labels(labels))
    auto = lexicon.matcher()
    clean = [r for r in rows if lexicon.score(lexicon.strength(auto, r[1] or "")[0]) < 0.3]
    clean = list(dict.fromkeys(clean))
    single = {i for i, _, _, kept in linked_groups(clean, 80) if kept}
    forms = {"EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "IP": r"\b[0-9]+(?:\.[0-9]+){3}\b"}
    private = [(i, None if t is None else re.sub(forms["IP"], "[IP]", re.sub(forms["EMAIL"], "[EMAIL]", t)), s) for i, t, s in clean if i in single]
    n_chars = [(i, t, "en", s, None if t is None else len(t), 1, 2, "k", "mine", 1, "x") for i, t, s in private]
    plain, want = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json")), Counter()
    texts = {i: t for i, t, _ in private}
    for r in mix_report(spark.createDataFrame(n_chars, d.schema)).collect():
        if r.times:
            want[r.doc_id, len(plain.encode(texts[r.doc_id], add_special_tokens=False).ids) + 1] += r.times
    got = Counter((r.doc_id, r.length) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want and len(single) > 200
    empty = tmp_path / "empty"
    d.limit(0).write.parquet(f"{empty}/documents.parquet")
    labels.limit(0).write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
    seen = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen = stage(spark, seen, str(tmp_path))
        assert seen.columns == d.columns and seen.where("row <> 'mine' or m_key <> 1 or r_text <> 'x'").count() == 0


def test_toxic_scores_by_plain_search(spark):
    """Scores of the automaton against a search word by word."""
    from lexispark.llm import toxicity as tox

    lexicon = tox.Lexicon({"idiot": 2.0, "scum": 3.0, "um": 1.5}, {"village idiot", "scum bag"}, offset=-3.0, slope=2.0)
    texts = ["You 1D10T!", "the village idiot, an idiot", "scum bag scum", "ѕсum um scumbag", "a" * 30_000 + " idiot", "village" + " " * 500 + "idiot", "", None, "um" * 50]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(None, "idiot", "s"), (1, texts[1], "s")]
    weights, spared = {tox.folded(w): x for w, x in lexicon.weights.items()}, {tox.folded(p) for p in lexicon.exceptions}
    lexicon = tox.Lexicon(weights, spared, lexicon.offset, lexicon.slope)

    def slow(text):
        folded = tox.folded(text or "")
        run, total = tox._RUN.findall(folded), 0.0
        for i, w in enumerate(run):
            around = {f"{run[i - 1]} {w}"} if i else set()
            around |= {f"{w} {run[i + 1]}"} if i + 1 < len(run) else set()
            total += weights.get(w, 0.0) ** 2 * (not around & spared)
        strength = total / (4.0 + math.log2(1 + len(folded) / 64))
        return 1 / (1 + math.exp(-(lexicon.offset + lexicon.slope * math.sqrt(strength))))

    got = tox.scored(docs(spark, rows), lexicon).collect()
    assert len(got) == len(rows)
    for r in got:
        assert abs(r.score - slow("idiot" if r.doc_id is None else texts[r.doc_id])) < 1e-9


def test_queries_are_complete():
    import corpus_pipeline
    from lexispark.llm import queries

    assert [int(k[2:].split("_")[0]) for k in queries.queries()] == list(range(1, 11))
    assert len(corpus_pipeline.STAGES) == 5
