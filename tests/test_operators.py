"""Operators on small fixed inputs, nulls and empty tables among them."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lexispark.operators import fuzzy, metrics, sampling, structured, voting
from lexispark.operators import lifecycle as life

VOTES = "row_id long, clf_idx int, clf string, prediction string, prob double"


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_nearest(spark):
    train = spark.createDataFrame([("AB CD", "p", 1), ("ABCE", "q", 2)], "d string, c string, i int")
    new = spark.createDataFrame([("ABCD",), ("zzzz",), (None,)], "d string")
    found = {r.d: (r.prediction, r.similarity) for r in fuzzy.nearest(new, train, "d", "c", "i", "jaro", 0.85).collect()}
    assert found == {"ABCD": ("p", 1.0), "zzzz": (None, None), None: (None, None)}


def test_unanimous(spark):
    train = spark.createDataFrame([("abcdefgh", "p"), ("abcdefgx", "q")], "d string, c string")
    new = spark.createDataFrame([("abcdefgh", 1), ("abcdefgy", 2)], "d string, k int")
    got = {r.k: (r.n_matches, r.n_classes, r.prediction) for r in fuzzy.unanimous(new, train, "d", "c", "k").collect()}
    assert got[1][:2] == (2, 2) and got[1][2] is None


def test_pruned_join_is_brute_force(spark):
    import random

    from lexispark.functions.similarity import dl_similarity, jaro

    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 12)))
    known, new = sorted({word() for _ in range(120)}), sorted({word() for _ in range(60)})
    k, n = spark.createDataFrame([(x,) for x in known], "k_text string"), spark.createDataFrame([(x,) for x in new], "n_text string")
    for measure, f in (("jaro", jaro), ("dl", dl_similarity)):
        got = {(r.n_text, r.k_text) for r in fuzzy.matches(n, k, measure, 0.7).collect()}
        assert got == {(a, b) for a in new for b in known if round(f(a, b) + 1e-9, 2) >= 0.7}


def _garbled(rng, text):
    """text with a few signs changed, gone, new or swapped."""
    t = list(text)
    for _ in range(rng.randint(0, 1 + len(t) // 8)):
        at, how = rng.randrange(len(t) + 1), rng.randrange(4)
        t[at : at + 1 + (how == 3)] = [[rng.choice("abcXYZ019.%")], [], t[at : at + 1] + [rng.choice("abc")], t[at : at + 2][::-1]][how]
    return "".join(t)


@pytest.mark.parametrize("measure, least", [("jaro", 0.75), ("jaro", 0.92), ("jaro", 0.97), ("dl", 0.75), ("dl", 0.9), ("dl", 1.0), ("jaro", None), ("dl", None)])
def test_index_is_brute_force(spark, measure, least):
    import random

    from lexispark.functions.similarity import dl_similarity, jaro

    rng = random.Random(7)
    base = ["".join(rng.choice("abcdefghijklmnop  XYZ0123.") for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 20, 30, 60, 99, 101, 120]))) for _ in range(45)]
    known = sorted({_garbled(rng, b) for b in base for _ in range(3)} | {"", "aaaaaaaa", "aaaaaaaaaaaa", "é" * 9})
    new = sorted({_garbled(rng, b) for b in base} | {"", "aaaaaaaaa", "zz", "éééééééé"})
    k, n = spark.createDataFrame([(x,) for x in known] * 2 + [(None,)], "k_text string"), spark.createDataFrame([(x,) for x in new] * 2 + [(None,)], "n_text string")
    f = jaro if measure == "jaro" else dl_similarity
    two = {(a, b): int(f(a, b) * 100 + 0.5 + 1e-9) / 100 for a in new for b in known}
    want = {(a, b, s) for (a, b), s in two.items() if s >= (max(two[a, x] for x in known) if least is None else least)}
    got = [tuple(r) for r in fuzzy.matches(n, k, measure, least, index_from=0).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    if least is not None:
        short = lambda c: F.length(c).between(1, fuzzy.WIDE)
        met = {tuple(r) for r in fuzzy.candidates(n.where(short("n_text")).distinct(), k.where(short("k_text")).distinct(), measure, least).collect()}
        assert {(a, b) for a, b, _ in want if a and b and max(len(a), len(b)) <= fuzzy.WIDE} <= met


def test_candidates_are_few(spark):
    """Texts of six words of 500, each with one near one: a tenth of all pairs share enough rare signs."""
    words = F.array(*(F.lit(a + b + c) for a in ("bra", "con", "del", "fur", "gly", "hem", "inj", "kal", "lum", "mor") for b in ("o", "ti", "ne", "ma", "") for c in ("x", "n", "st", "l", "r", "Q1", "Z2", "/x", "7", "V")))
    k = spark.range(600).select(F.concat(*(F.get(words, F.pmod(F.xxhash64("id", F.lit(i)), F.lit(500))) for i in range(6))).alias("k_text"))
    new = k.select(F.concat(F.lit("x"), F.expr("substring(k_text, 1, length(k_text) - 2)")).alias("n_text"))
    met = fuzzy.candidates(new, k, "dl", 0.9).distinct().count()
    assert 600 <= met <= 0.12 * 600**2


def test_jaro_of_many_is_jaro():
    import random

    import numpy as np

    from lexispark.functions.similarity import jaro, jaro_many

    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdé") for _ in range(rng.choice([0, 1, 2, 3, 7, 20, 40]))) for _ in range(150)]
    codes, sizes = np.zeros((150, 40), dtype=np.uint32), np.array([len(t) for t in texts])
    for row, t in zip(codes, texts):
        row[: len(t)] = [ord(c) for c in t]
    for a in [*texts[:40], "", "a", "zz"]:
        assert jaro_many(a, codes, sizes).tolist() == [jaro(a, t) for t in texts]


def test_boost(spark):
    d = spark.createDataFrame([(0.87,), (0.9,), (0.84,)], "s double").select(fuzzy.boosted(F.col("s")))
    assert [r[0] for r in d.collect()] == [0.91, 0.9, 0.84]


def test_review_gate(spark):
    d = spark.createDataFrame([(80.0, None), (95.0, "u1"), (95.0, ""), (95.0, None), (None, "u1")], "c double, u string")
    assert [r.u for r in d.where(life.review_gate(F.col("c"), F.col("u"), 90)).collect()] == [None, "u1"]


def test_upsert_and_relabel(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    s = spark.createDataFrame([("b", None), ("c", 3)], "k string, v int")
    assert rows(life.upserted(t, s, "k"), "k") == [("a", 1), ("b", None), ("c", 3)]
    asked = spark.createDataFrame([("a", 7, 1), ("a", 8, 2)], "k string, n int, at int")
    assert rows(life.relabelled(t, asked, "k", "v", "n", ["at"]), "k") == [("a", 8), ("b", 2)]


def test_corpus_keeps_the_new(spark):
    old = spark.createDataFrame([("iv", "old", dt.date(2020, 1, 1))], "w string, m string, d date")
    new = spark.createDataFrame([("iv", "new", dt.date(2019, 1, 1))], "w string, m string, d date")
    assert [r.m for r in life.corpus_merged(old, new, ["w"], "d", "m").collect()] == ["new"]


def test_flag_ratio(spark):
    d = spark.createDataFrame([("ONLINE",)], "f string")
    assert life.flag_ratio(d, "f", "ONLINE", "RETROSPECTIVE").first()[0] == -9.9


def test_bins(spark):
    d = spark.createDataFrame([(0.0,), (4.0,), (4.01,), (-10.0,), (None,)], "a double")
    got = [r[0] for r in d.select(structured.interval(F.col("a"), structured.AMOUNT_EDGES)).collect()]
    assert got == ["(-10, 0]", "(0, 4]", "(4, 17]", None, None]
    u = spark.createDataFrame([(1.0,), (1.5,), (0.0,)], "a double").select(structured.units_bin(F.col("a")))
    assert [r[0] for r in u.collect()] == ["Units <= 1", "Units > 1", None]


@pytest.mark.parametrize("code, name", [(110, "Room & Board"), (250, "Pharmacy"), (258, "IV Solutions"), (331, "Pharmacy"), (391, "Blood Administration"), (690, "Others"), (735, "EKG/ECG/EEG"), (745, "Surgery/Procedure"), (972, "Radiology"), (974, "Pharmacy")])
def test_revenue_groups(spark, code, name):
    assert spark.range(1).select(structured.revenue_group(F.lit(code))).first()[0] == name


def test_dominance(spark):
    d = spark.createDataFrame([(100.0, "Laboratory")], "b double, c string")
    assert rows(structured.dominance(d, "b", "c")) == [(100.0, "Laboratory", "", 1, 100.0, 0.0)]


def test_vote(spark):
    v = spark.createDataFrame([(1, 0, "Jaro", "A", 0.9), (1, 1, "DLevenshtein", "B", 0.8), (1, 2, "Logistic_OvR", "B", 0.5), (1, 3, "DeepNN", "A", 0.3), (2, 0, "Jaro", None, None)], VOTES)
    got = {r.row_id: r for r in voting.majority(v).withColumn("c", voting.confidence(F.col("n_agree"), F.col("sum_prob"))).collect()}
    assert (got[1].vote, got[1].algorithms) == ("B", "DLevenshtein, Logistic_OvR") and abs(got[1].c - 0.325) < 1e-12
    assert (got[2].vote, got[2].algorithms, got[2].n_agree) == ("", "", 0)


@pytest.mark.parametrize("clf, p, want", [("Logistic_OvR", 0.85, 0.96), ("Logistic_OvR", 0.9, 0.9), ("Logistic_OvR", 0.79, 0.92), ("Logistic_OvR", 0.65, 0.76), ("Logistic_OvR", 0.59, 0.59), ("DLevenshtein", 0.55, 0.81), ("Jaro", 0.82, 0.85), ("Jaro", 0.85, 0.85)])
def test_bands(spark, clf, p, want):
    assert spark.range(1).select(voting.band_boosted(F.lit(clf), F.lit(p))).first()[0] == want


def test_upsampling(spark):
    d = spark.createDataFrame([(i, "x" if i < 3 else "y") for i in range(15)], "k long, c string")
    got = {r.c: r["count"] for r in sampling.upsampled(d, "c", "k").groupBy("c").count().collect()}
    assert got == {"x": 10, "y": 12}
    assert sampling.upsampled(d.limit(0), "c", "k").count() == 0


_KEYS = {
    "long": ("long", [*range(40), 2**60, 2**60 + 1, 2**63 - 1, -(2**63), -5, None, None]),
    "string": ("string", [*(f"clm-{i}" for i in range(42)), "", None, None, "é", "x" * 5000]),
    "decimal": ("decimal(38,0)", [__import__("decimal").Decimal(10**30 + i) for i in range(45)] + [None, None]),
    "date": ("date", [__import__("datetime").date(2020, 1, 1 + i % 28) for i in range(47)]),
}


@pytest.mark.parametrize("kind", _KEYS)
def test_splits_and_samples_take_keys_of_any_type(spark, kind):
    schema, keys = _KEYS[kind]
    d = spark.createDataFrame([(k, "x" if i < 4 else "yz"[i % 2], i) for i, k in enumerate(keys)], f"k {schema}, c string, n int")
    whole = sorted(r.n for r in d.collect())
    for share in (0.0, 0.3, 1.0):
        train, test = sampling.hold_out(d, "k", share)
        assert sorted(r.n for r in train.unionByName(test).collect()) == whole
    train, test, _ = sampling.hold_out_with_classes(d, "k", "c", 0.3)
    assert sorted(r.n for r in train.unionByName(test).collect()) == whole
    assert {r.c: r["count"] for r in sampling.upsampled(d, "c", "k").groupBy("c").count().collect()}["x"] == 10
    fold = sampling.folds(d, "c", "k", 5)
    assert sorted(r.n for r in fold.collect()) == whole
    sizes = fold.groupBy("c", "fold").count().collect()
    assert all(max(r["count"] for r in sizes if r.c == c) - min(r["count"] for r in sizes if r.c == c) <= 1 for c in "yz")
    few = sampling.stratified(d, "c", "k", 20, slack=0)
    assert {r.c: r["count"] for r in few.groupBy("c").count().collect()} == {c: round(sum(r.c == c for r in d.collect()) * 20 / len(keys)) for c in "xyz"}


def test_training_takes_text_keys(spark):
    from lexispark.plans import pipeline

    d = spark.createDataFrame([(f"id-{i}", ["red bolt", "blue gear", "old ring"][i % 3] + f" {i % 5}", "abc"[i % 3]) for i in range(45)], "k string, t string, c string")
    out = pipeline.train_and_classify(d, "t", "c", "k", 0.3, [c for c in __import__("lexispark.operators.classify", fromlist=["registry"]).registry() if c.name in ("Jaro", "Logistic_OvR")]).collect()
    assert out and all(r.match == 1 for r in out)


def test_equal_texts_are_learned_and_classified_once(spark):
    from lexispark.operators import classify, features
    from lexispark.plans import pipeline

    d = spark.createDataFrame([(i, ["red bolt", "blue gear", "old ring"][i % 3], "abc"[i % 3]) for i in range(600)], "k long, t string, c string")
    seen = []

    class Told:
        def predict(self, df, _):
            seen.append(df.count())
            return df.withColumn("prediction", F.lit("a")).withColumn("prob", F.lit(1.0))

    def told(df, features, label, copies=None):
        seen.append((df.count(), copies and df.agg(F.sum(copies)).first()[0]))
        return Told()

    train, _, _ = sampling.hold_out_with_classes(d, "k", "c", 0.3)
    n = train.count()
    out = pipeline.train_and_classify(d, "t", "c", "k", 0.3, [classify.Classifier("W", told, weighted=True), classify.Classifier("P", lambda df, f, l: told(df, f, l))]).collect()
    assert seen == [(3, n), (n, None), 3, 3] and sorted(r.k for r in out) == sorted({r.k for r in d.collect()} - {r.k for r in train.collect()})

    bag = features.bag_of_words("t", "f").fit(d).transform(d.withColumn("t", F.when(F.col("k") == 7, "red red gear").otherwise(F.col("t"))))
    once = bag.groupBy("t", "f").agg(F.count("*").alias("n"))
    for deviation in (0.03, 0.41, 0.4715, 1.0):
        every, few = features.varying(bag, "f", deviation=deviation), features.varying(once, "f", deviation=deviation, copies="n")
        assert (every and [*every.selectedFeatures]) == (few and [*few.getIndices()])


def test_phrases_are_counted_in_parts_of_bounded_size(spark, monkeypatch):
    import random
    from collections import Counter

    from lexispark.operators import features

    rng = random.Random(4)
    names = [x + y for x in "abcdefgh" for y in "klmno"]
    texts = [" ".join(rng.choices(["the", *names], [600, *range(1, 41)], k=rng.randint(0, 30))) + " new york" * (i % 3) for i in range(150)] + [None, "", "york"]
    words = [t.split() for t in texts if t]
    n, pairs = Counter(w for t in words for w in t), Counter(p for t in words for p in zip(t, t[1:]))
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    monkeypatch.setattr(features, "PAIRS", 100, raising=False)
    for least, score, common in ((2, 0.2, 10_000), (2, 0.02, 10_000), (2, 0.02, 1), (1, 0.0, 10_000), (0, 0.05, 10_000)):
        monkeypatch.setattr(features, "COMMON", common, raising=False)
        found = features.bigram_phrases(d, "t", least, score)
        worth = {p: (k - least) * len(n) / (n[p[0]] * n[p[1]]) for p, k in pairs.items() if k >= least}
        want = sorted((*p, pairs[p], round(x, 6)) for p, x in worth.items() if x > score)
        assert want and [(r.a, r.b, r.n, pytest.approx(r.score, abs=2e-6)) for r in sorted(found.collect())] == want
        parts = 1 + sum(n.values()) // 100
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(f"], {parts}") + plan.count(f"Repartition {parts}, true") == 2, plan
    assert features.bigram_phrases(d.where("false"), "t").collect() == []


def test_sparse_correlations(spark):
    import numpy as np
    from pyspark.ml.linalg import SparseVector, Vectors, VectorUDT
    from pyspark.sql import types as T

    rng = np.random.default_rng(6)
    x = (rng.random((80, 14)) < 0.2) * rng.integers(-1, 4, (80, 14)).astype(float)
    x[:, 3], x[:, 4], x[:, 5], x[:, 6] = x[:, 2] * 2, -x[:, 1], 0, 1  # alike, opposite, never, always there
    x[:, 7] = np.arange(80) < 45
    x[:, 8] = 1 - x[:, 7]  # never meets 7
    as_vector = lambda i, r: Vectors.dense(r) if i % 3 else SparseVector(14, np.flatnonzero(r).tolist(), r[np.flatnonzero(r)].tolist())
    d = spark.createDataFrame([(as_vector(i, r), "k") for i, r in enumerate(x)] + [(None, "k")], T.StructType([T.StructField("v", VectorUDT()), T.StructField("i", T.StringType())])).repartition(3)
    for least in (0.1, 0.5, 0.999):
        got = {(r.a, r.b): r.r for r in metrics.sparse_correlations(d, "v", least).collect()}
        with np.errstate(invalid="ignore"):
            c = np.corrcoef(x.T)
        want = {(a, b): c[a, b] for a in range(14) for b in range(a + 1, 14) if abs(c[a, b]) >= least + 1e-12}
        assert got.keys() >= want.keys() and all(abs(r - c[k]) < 1e-9 and abs(c[k]) >= least - 1e-9 for k, r in got.items())
    assert metrics.sparse_correlations(d.limit(0), "v", 0.5).count() == 0


@pytest.mark.parametrize("large", [10**6, 40, 3])
def test_medians_by_selection(spark, large):
    import random
    import statistics

    rng, by = random.Random(4), {}
    for k, n, draw in [("a", 301, rng.random), ("b", 200, lambda: 2.0 ** rng.randint(-300, 300)), ("c", 90, lambda: float(rng.randint(0, 2))), (None, 77, lambda: -(rng.random() ** 9)), ("d", 50, lambda: 5.0), ("e", 1, lambda: 1.0), ("f", 60, lambda: rng.choice([-1e308, 1e308]))]:
        by[k] = [draw() for _ in range(n)]
    data = [(k, i, v) for k, vs in by.items() for i, v in enumerate(vs)] + [("g", 0, None), ("a", -1, None)] + [("h", i, None) for i in range(50)]
    d = spark.createDataFrame(data, "k string, i int, v double").repartition(4)
    got = {r.k: (r.v, r.i) for r in structured.grouped_medians(d, ["k"], ["v"], ["i"], ["i"], large=large).collect()}
    assert got.keys() == {*by, "g", "h"} and got["g"][0] is None and got["h"][0] is None
    for k, vs in by.items():
        if k != "f":  # half of 1e308 and -1e308 is 0, or either
            assert got[k][0] == pytest.approx(round(statistics.median(vs), 6), rel=1e-12, abs=1e-6), k
        assert got[k][1] == (-1 if k == "a" else 0)


def test_folds_are_even(spark):
    d = spark.createDataFrame([(i, "x" if i % 3 else "y") for i in range(60)], "k long, c string")
    got = sampling.folds(d, "c", "k", 5).groupBy("c", "fold").count().collect()
    assert {(r.c, r["count"]) for r in got} == {("x", 8), ("y", 4)}


def test_report(spark):
    d = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "y string, p string")
    assert rows(metrics.class_report(d, "y", "p"), "label") == [("a", 1.0, 0.5, 2), ("b", 0.333333, 1.0, 1), ("c", 0.0, 0.0, 1)]


def test_bag_holds_every_word(spark):
    from lexispark.operators import features

    d = spark.range(30).select("id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(10_000)), lambda i: F.concat(F.lit("w"), i + 10_000 * F.col("id"))), " ").alias("text"))
    assert len(features.vocabulary_of(features.bag_of_words("text").fit(d))) == 300_000
    assert {r.n for r in features.word_counts(d, "id", "text").groupBy("id").agg(F.sum("n").alias("n")).collect()} == {10_000}


def test_correct_votes(spark):
    v = spark.createDataFrame([(1, 0, "a", "x", 0.9), (1, 1, "b", None, 0.1), (2, 0, "a", "y", 0.9), (2, 1, "b", "x", 0.2)], VOTES)
    actual = spark.createDataFrame([(1, "x"), (2, "x")], "row_id long, cls string")
    got = voting.correct_votes(v, actual, "cls", ["a", "b"])
    assert rows(got.select("row_id", "Correct_a", "Correct_b"), "row_id") == [(1, 1, 0), (2, 0, 1)]


def test_uncorrelated_is_pairwise(spark):
    import numpy as np
    from pyspark.ml.linalg import Vectors

    from lexispark.operators import features

    rng = np.random.default_rng(5)
    x = rng.integers(0, 3, (200, 6)).astype(float)
    x = np.column_stack([x, 2 * x[:, 0] + 1, 1 - x[:, 2], x[:, 1] + 1e-3 * rng.standard_normal(200), np.ones(200), x[:, 0] + x[:, 1], -x[:, 0]])
    d = spark.createDataFrame([(Vectors.dense(r),) for r in x], ["v"])
    with np.errstate(invalid="ignore", divide="ignore"):
        r = np.abs(np.corrcoef(x.T))
    want = [i for i in range(x.shape[1]) if not any(r[i, j] >= 1 - 1e-12 for j in range(i + 1, x.shape[1]))]
    assert list(features.uncorrelated(d, "v").getIndices()) == want


def test_linear_models(spark):
    import numpy as np
    from pyspark.ml.linalg import Vectors

    from lexispark.operators import classify

    rng = np.random.default_rng(1)
    data = []
    for i in range(300):
        x = rng.standard_normal(5) + 4 * np.eye(5)[i % 3]
        data.append((Vectors.dense(x) if i % 2 else Vectors.sparse(5, range(5), x.tolist()), "abc"[i % 3], i))
    d = spark.createDataFrame(data, ["v", "y", "i"])
    for train in (classify.boosted_linear(rounds=8), classify.discriminant()):
        model = train(d.where("i >= 100"), "v", "y")
        assert d.where("i < 100").count() - model.predict(d.where("i < 100"), "v").where("prediction = y").count() <= 3
    # the discriminant's scores against the textbook's
    x, y = np.array([v.toArray() for v, _, _ in data]), np.array([c for _, c, _ in data])
    model = classify.discriminant(shrink=0.0)(d, "v", "y")
    means = np.array([x[y == c].mean(axis=0) for c in "abc"])
    within = sum((x[y == c] - m).T @ (x[y == c] - m) for c, m in zip("abc", means)) / (len(x) - 3)
    inverse = np.linalg.inv(within)
    assert np.allclose(model.weights, means @ inverse, atol=1e-6)
    assert np.allclose(model.bias, [np.log(1 / 3) - m @ inverse @ m / 2 for m in means], atol=1e-6)


def test_network_weights_give_its_predictions(spark):
    import numpy as np
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.linalg import Vectors

    from lexispark.operators import classify

    rng = np.random.default_rng(2)
    x = rng.standard_normal((60, 3))
    d = spark.createDataFrame([(Vectors.dense(r), "ab"[int(r[0] > 0)], i) for i, r in enumerate(x)], ["v", "y", "i"])
    model = classify.multiclass(lambda w, k: MultilayerPerceptronClassifier(layers=[w, 4, k], maxIter=20, seed=1))(d, "v", "y")
    one, two = classify.network_weights(model)
    out = np.vstack([1 / (1 + np.exp(-(x @ one[:-1] + one[-1]))).T, np.ones(60)]).T @ two
    share = np.exp(out) / np.exp(out).sum(axis=1, keepdims=True)
    assert np.allclose(share.max(axis=1), [r.prob for r in model.predict(d, "v").orderBy("i").collect()])


def test_phrases_are_one_word(spark):
    from lexispark.operators import features

    d = spark.createDataFrame([(["a", "b", "c", "a", "b"],), (["b", "c", "d"],), ([],), (None,)], "w array<string>")
    pairs = spark.createDataFrame([("a", "b"), ("b", "c")], "a string, b string")
    assert [r.w for r in features.phrased(d, "w", pairs).collect()] == [["a_b", "c", "a_b"], ["b_c", "d"], [], []]


def test_subsampled_words(spark):
    from lexispark.operators import features

    d = spark.createDataFrame([(i, ["often"] * 50 + [f"w{i}"]) for i in range(400)] + [(None, None), (None, []), (7, [None, "often"])], "k long, w array<string>")
    got = features.subsampled(d, "w", "k", 0.01)
    n = got.select(F.explode("w").alias("w")).groupBy("w").count().collect()
    share = {r.w: r["count"] for r in n}
    f = 20001 / 20402
    assert abs(share["often"] / 20001 - ((f / 0.01) ** 0.5 + 1) * 0.01 / f) < 0.01 and share[None] == 1 and len(share) == 402 and got.count() == 403
    assert sorted(map(str, got.collect())) == sorted(map(str, features.subsampled(d.repartition(3), "w", "k", 0.01).collect()))
    assert features.subsampled(d.limit(0), "w", "k").isEmpty()
    texts = d.where("k is not null").select("k", F.array_join("w", " ").alias("t"))
    assert features.word_vectors(texts, "t", size=4, sample=0.01, key="k", least=1).where("word = 'often'").count() == 1
