"""Stems: the published examples, odd words, and the rules once more letter by letter."""

import random

from lexispark.functions import stems, text

# The published examples of each step, run through all steps.
EXAMPLES = (
    "caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size "
    "hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc hesitanci hesit "
    "digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal "
    "decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr "
    "electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit "
    "replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect "
    "bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll generalizations gener oscillators oscil"
).split()


def vowel(w, i):
    return w[i] in "aeiou" or (w[i] == "y" and i > 0 and not vowel(w, i - 1))


def measure(w):
    shape = "".join("v" if vowel(w, i) else "c" for i in range(len(w)))
    return sum(a == "v" and b == "c" for a, b in zip(shape, shape[1:]))


def any_vowel(w):
    return any(vowel(w, i) for i in range(len(w)))


def short(w):
    n = len(w)
    return n > 2 and not vowel(w, n - 1) and vowel(w, n - 2) and not vowel(w, n - 3) and w[-1] not in "wxy"


def suffixed(w, rules, least):
    fits = [r for r in rules if w.endswith(r[0])]
    if not fits:
        return w
    suffix, new = max(fits, key=lambda r: len(r[0]))
    stem = w[: len(w) - len(suffix)]
    return stem + new if measure(stem) > least and (suffix != "ion" or stem[-1:] in ("s", "t")) else w


def plain(w):
    if len(w) < 3:
        return w
    if w.endswith("s") and not w.endswith("ss"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and any_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and not vowel(w, len(w) - 1) and w[-1] not in "lsz":
                    w = w[:-1]
                elif measure(w) == 1 and short(w):
                    w += "e"
                break
    if w.endswith("y") and any_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = suffixed(suffixed(w, stems.STEP_2, 0), stems.STEP_3, 0)
    w = suffixed(w, [(s, "") for s in stems.STEP_4], 1)
    if w.endswith("e") and (measure(w[:-1]) > 1 or (measure(w[:-1]) == 1 and not short(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and measure(w) > 1 else w


def stemmed(spark, words):
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", stems.porter_stem("w").alias("s")).collect()
    return {r.w: r.s for r in rows}


def test_published_examples(spark):
    want = dict(zip(EXAMPLES[::2], EXAMPLES[1::2]))
    assert stemmed(spark, want) == want and {w: plain(w) for w in want} == want


def test_random_words(spark):
    """Syllables with many y's, double letters and all suffixes."""
    rng = random.Random(786)
    ends = ["", "s", "es", "ed", "eed", "ing", "y", "e", "ll", "ies", "sses", *(s for s, _ in stems.STEP_2 + stems.STEP_3), *stems.STEP_4]
    words = {"".join(rng.choice("abcelostyyzx") for _ in range(rng.randint(0, 6))) + rng.choice(ends) + rng.choice(["", "", "s", "ed", "ing", "y"]) for _ in range(6000)}
    assert stemmed(spark, words) == {w: plain(w) for w in words}


def test_odd_words(spark):
    words = ["", "a", "is", "x9s", "naïves", "two words", "Running", "y", "yyy", "s" * 5000]
    got = stemmed(spark, [*words, None])
    assert got == {**{w: w for w in words[:7]}, None: None, "y": "y", "yyy": plain("yyy"), "s" * 5000: "s" * 5000}


def test_option_and_lemmas(spark):
    d = spark.createDataFrame([("The cats/dogs were Hopping",), ("==cats",), (None,)], "t string")
    assert [r[0] for r in d.select(text.sentence_tokens("t", ["the"], stem=True)).collect()] == [["cat", "dog", "were", "hop"], [], None]
    lemmas = spark.createDataFrame([("were", "be"), ("were", "bee"), ("cats", None), ("x", "y")], "word string, lemma string")
    tokens = spark.createDataFrame([(["were", "cats", None],), (["were"],), (None,), ([],)], "w array<string>")
    assert sorted(tuple(r) for r in stems.stems(tokens, "w", lemmas).collect()) == [("cats", "cat"), ("were", "be")]
    assert stems.stems(tokens.limit(0), "w").isEmpty()
