"""Text functions, similarity and corrections against fixed cases and, where there is one, another engine."""

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexispark.functions import corrections, text
from lexispark.functions import similarity as sim


def one(spark, value, f, *more):
    return spark.createDataFrame([(value, *more)], "a string" + "".join(f", m{i} string" for i in range(len(more)))).select(f("a", *(f"m{i}" for i in range(len(more))))).first()[0]


def test_cleaning(spark):
    assert one(spark, 'A-B  "x",1%', text.charset_clean) == "A B x 1%"
    assert one(spark, "HC GLUCOSE", text.strip_lead) == "GLUCOSE"
    assert one(spark, "HCG TEST", text.strip_lead) == "HCG TEST"
    assert one(spark, ' "a",b\r\n', text.line_clean) == "a  b"
    assert one(spark, "a,b  c", text.correction_clean) == "a b c"
    assert one(spark, None, text.charset_clean) is None


def test_tokens(spark):
    tokens = lambda c: text.sentence_tokens(c, text.stop_words())
    assert one(spark, "The TUBE/Catheter and 5/8IN set", tokens) == ["tube", "catheter", "5/8in", "set"]
    assert one(spark, "== heading", tokens) == []
    assert one(spark, "", tokens) == []
    assert one(spark, "a b c", text.word_grams) == ["a b", "b c", "a b c"]
    assert one(spark, "a", text.word_grams) == []


def test_features(spark):
    short = F.create_map(F.lit("intravenous"), F.array(F.lit("IV")))
    f = lambda a, b: text.feature_tokens(a, b, short)
    assert one(spark, "intravenous solution 500 ml/hr bag", f, "IV SOLN 500 ML/HR BAG") == ["iv", "solution", "ml", "hr"]
    assert one(spark, "", f, "x") == ["", "", "", ""]


def test_change_map(spark):
    assert one(spark, "iv:intravenous||soln:solution", text.change_map) == {"intravenous": "iv", "solution": "soln"}
    assert one(spark, "a:x||b:x", text.change_map) == {"x": "b"}
    assert one(spark, "", text.change_map) == {}


def test_join_expansions(spark):
    known = {"knee replacement", "total knee replacement"}
    assert one(spark, "total knee replacement kit", lambda c: corrections.join_expansions(c, known)) == "total knee_replacement kit"
    assert one(spark, None, lambda c: corrections.join_expansions(c, known)) is None


def test_surround():
    assert corrections.surround("iv:intravenous", "iv soln bag") == "iv:intravenous:soln"
    assert corrections.surround("bag:x", "iv bag") == "bag:x:iv"
    assert corrections.surround("bag:x", "bag") == "bag:x:"
    assert corrections.surround("b:x", "a/b/c") == "b:x:c"
    assert corrections.surround(None, "a") == ""


@pytest.mark.parametrize(
    "original, norm, changes, corrected, expansions, abbreviations, spellings",
    [
        ("ring smll", "ring smll", None, "ring small", None, None, "smll:small;"),
        ("ring", "ring", None, "ring", None, None, None),
        ("ring xx", "ring xx", None, "ring", None, None, "xx:NoChange;"),
        ("soln bag", "solution bag", "soln:solution", "saline bag", None, None, "soln:saline;"),
        # a word that stands for several, and words that a lost one became
        ("tkr kit", "tkr kit", None, "total knee replacement kit", None, "tkr:total_knee_replacement;", None),
        ("kit xq", "kit xq", None, "kit for wound care", None, "xq:for_wound_care;", None),
        # joined expansions are kept apart, joined or as one word
        ("tkr kit", "total_knee_replacement kit", "tkr:total_knee_replacement", "Total Knee Replacement kit", None, None, None),
        ("icu bed", "in_tube bed", "icu:in_tube", "intube bed", None, None, None),
        ("iv set", "intra_venous set", "iv:intra_venous", "internal valve set", None, "iv:internal_valve;", None),
        # known expansions, by the abbreviation that the original has
        ("iv bag", "intravenous bag", "iv:intravenous", "invasive bag", {"intravenous": ["ivn", "IV"]}, "IV:invasive;", None),
        # order is kept: what comes after decides which word of equal initials is meant
        ("sal sol", "sal sol", None, "saline sterile solution", None, "sol:sterile_solution;", "sal:saline;"),
        ("bolt ring", "bolt ring", None, "ring bolt", None, None, "bolt:NoChange;"),
        # numbers, single signs, slashes and signs that are no letters
        ("500 ml/hr x bag", "500 ml/hr x bag", None, "250 ML / HR, bag", None, None, None),
        ("", "", None, "", None, None, None),
        ("a  b", "aa  bb", "aa", "ab bc", None, None, "aa:ab;bb:bc;"),
    ],
)
def test_mining(original, norm, changes, corrected, expansions, abbreviations, spellings):
    assert corrections.mine(original, norm, changes, corrected, expansions) == (abbreviations, spellings)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["ab", "ac", "bc", "b_c", "12"]), max_size=4), st.lists(st.sampled_from(["ab", "a", "bc", "b", "c", "12"]), max_size=5))
def test_alignment_is_the_best(tokens, target):
    def best(i, j):
        if i == len(tokens) or j == len(target):
            return (0, 0)
        ways = [best(i + 1, j), best(i, j + 1)]
        for _, w, g in corrections._steps(tokens[i], target, j):
            rest = best(i + 1, j + w)
            ways.append((g[0] + rest[0], g[1] + rest[1]))
        return max(ways)

    path = corrections.aligned(tokens, target)
    assert (sum(k == "kept" for k, *_ in path), sum(k == "changed" for k, *_ in path)) == best(0, 0)
    assert [i for k, i, _, _ in path if k != "new"] == list(range(len(tokens)))
    assert [x for k, _, j, w in path for x in range(j, j + w)] == list(range(len(target)))


def test_change_rows(spark):
    d = spark.createDataFrame([("iv:intravenous:soln;x:NoChange:",), (None,), ("",)], "c string")
    assert [tuple(r) for r in corrections.change_rows(d, "c").collect()] == [("iv", "intravenous", "soln")]


@pytest.mark.parametrize("a, b, jaro, dl", [("dear", "bear", 0.83, 0.75), ("", "", 0.0, 0.0), ("ca", "abc", None, 0.33), ("AB CD", "AB-CD", 1.0, 1.0)])
def test_similarity(spark, a, b, jaro, dl):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(sim.jaro_similarity("a", "b"), sim.damerau_similarity("a", "b")).first()
    assert jaro is None or row[0] == jaro
    assert row[1] == dl


_words = st.text("abcd", max_size=9)


@settings(max_examples=150, deadline=None)
@given(_words, _words)
def test_kernels_match_another_engine(a, b):
    jaro, dl = duckdb.execute("SELECT jaro_similarity(?, ?), damerau_levenshtein(?, ?)", [a, b, a, b]).fetchone()
    assert abs(sim.jaro(a, b) - jaro) < 1e-9
    assert sim.damerau_levenshtein(a, b) == dl


@settings(max_examples=80, deadline=None)
@given(_words, st.lists(_words, min_size=1, max_size=6))
def test_distances_of_several_at_once(a, others):
    width = max(map(len, others))
    codes = np.array([[ord(c) for c in o] + [0] * (width - len(o)) for o in others], dtype=np.uint32).reshape(len(others), width)
    got = sim.damerau_levenshtein_many(a, codes, np.array([len(o) for o in others]))
    assert got.tolist() == [sim.damerau_levenshtein(a, o) for o in others]


def test_rounding():
    assert sim.rounded(0.845) == 0.84 and sim.rounded(2.675) == 2.67 and sim.rounded(0.125) == 0.13


def test_cleaning_by_fewer_patterns_is_the_same(spark):
    """Against the patterns one after the other, on texts where addresses touch; a run of signs is not tried from each."""
    import time

    from pyspark.sql import functions as F

    from lexispark.functions import text

    odd = ["a@b_c@d x", "x.@y@z@@w", "@@a", "a@b@c@d e_f@g", "é_a@b.c-d_e@f 12 (3) ", "  a  b-c ", "", "-", "http://a@b c@d", "+49 (0)30 1234-5678 a1b", "1@2 3.4@5", None, "a+b%c>d/e&f,,g", "Ab\tcD\n"]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(odd)], "i int, t string")
    one = F.col("t")
    for pattern, new in ((r"[^\x00-\x7F]+", ""), (r"https?://[^ \t\n\r]+", " "), (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", " "), (r"[+]?[0-9][0-9() .-]{6,}[0-9]", " "), (r"[0-9]+", " "), (r"[^A-Za-z ]", " "), (r" {2,}", " ")):
        one = F.regexp_replace(one, pattern, new)
    signs = F.regexp_replace(F.regexp_replace("t", "[^A-Za-z0-9+%.>/&]", " "), " {2,}", " ")
    words = F.filter(F.split(F.lower(F.regexp_replace("t", "[^a-zA-Z]", " ")), r"\s+"), lambda w: w != "")
    for r in d.select("i", F.struct(F.trim(one), signs, words).alias("a"), F.struct(text.document_clean("t"), text.charset_clean("t"), text.corpus_tokens("t")).alias("z")).collect():
        assert tuple(r.a) == tuple(r.z), odd[r.i]
    began = time.time()
    assert spark.range(1).select(F.length(text.document_clean(F.repeat(F.lit("a"), 1_000_000)))).first()[0] == 1_000_000
    assert time.time() - began < 30


def test_known_and_new_texts_are_read_once(spark, tmp_path):
    """What J1 and J2 join are digests, which are there; the texts are in neither plan."""
    from lexispark.plans.queries_relational import known_texts
    from lexispark.plans.registry import Tables

    spark.createDataFrame([(1, "a b"), (2, "a, b"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    new, known = known_texts(Tables(spark, str(tmp_path)))
    assert sorted(r.doc_id for r in new.collect()) == [2, 3] and [r.train_id for r in known.collect()] == [1]
    assert all("regexp" not in x._jdf.queryExecution().optimizedPlan().toString() for x in (new, known))


def test_many_at_once_are_as_one_by_one():
    """Distances by a tree of prefixes, Jaro by places as bits, and the block search by either way."""
    import random

    import numpy as np
    import pandas as pd

    from lexispark.functions import similarity
    from lexispark.operators import fuzzy

    draw = random.Random(5)
    texts = ["".join(draw.choice("abcd\u00e9") for _ in range(draw.choice([0, 1, 2, 5, 9, 20]))) for _ in range(150)] + ["b" * 64]
    sizes = np.array([len(x) for x in texts])
    codes = np.zeros((len(texts), 64), dtype=np.uint32)
    for i, x in enumerate(texts):
        codes[i, : len(x)] = np.frombuffer(x.encode("utf-32-le"), dtype=np.uint32)
    tree, places = similarity.Prefixes(codes, sizes), similarity.Places(codes, sizes)
    for a in [*texts[:40], "", "zab", "a" * 70, "abc" * 30]:
        assert tree.distances(a).tolist() == [similarity.damerau_levenshtein(a, b) for b in texts]
        some = np.arange(0, len(texts), 2)
        assert places.jaro(a, some).tolist() == [similarity.jaro(a, texts[i]) for i in some]
    known, new = pd.DataFrame({"k_text": [*dict.fromkeys(texts)]}), pd.DataFrame({"n_text": [x[::-1] + "d" for x in texts[:30]], "n_least": [None, 0.4, None] * 10})
    for measure, one in (("jaro", similarity.jaro), ("dl", similarity.dl_similarity)):
        got = {(r.n_text, r.k_text) for r in fuzzy._best(known, new, measure).itertuples()}
        want = set()
        for text, least in zip(new["n_text"], new["n_least"]):
            two = {b: np.floor(one(text, b) * 100 + 0.5 + 1e-9) / 100 for b in known["k_text"]}
            bar = max(two.values()) if least != least else least
            want |= {(text, b) for b, x in two.items() if x >= bar}
        assert got == want
