"""Stems of English words by Porter's published rules (1980), as Column functions, and lemmas by a given table.

A word is a run of consonants and vowels; its measure m is how often a vowel run is followed by a consonant run. `y` is a
consonant at the start and after a vowel. Steps 1a to 5b each take the longest suffix that fits and change it where the
stem before it meets the rule's condition. Everything is regular expressions within the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Y stands for y as a consonant while the steps run.
_C, _V = "[^aeiouy]", "[aeiouy]"
_SOME = f"^{_C}*{_V}+{_C}"  # m > 0
_MORE = f"^{_C}*{_V}+{_C}+{_V}+{_C}"  # m > 1
_ONE = f"^{_C}*{_V}+{_C}+{_V}*$"  # m = 1
_SHORT = f"{_C}{_V}[^aeiouywxY]$"  # *o
_ONE_AND_SHORT = f"^{_C}+{_V}[^aeiouywxY]$"  # m = 1 and *o

# The published suffixes of steps 2 to 4 and what they become.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _stem_of(w: Column, suffix: str) -> Column:
    return w.substr(F.lit(1), F.length(w) - len(suffix))


def _longest_first(w: Column, rules, condition: str) -> Column:
    """The longest suffix that fits decides; it is changed where its stem meets the condition."""
    out = w
    for suffix, new in sorted(rules, key=lambda r: len(r[0])):
        stem = _stem_of(w, suffix)
        good = stem.rlike(condition) & stem.rlike("[st]$") if suffix == "ion" else stem.rlike(condition)
        out = F.when(w.endswith(suffix), F.when(good, F.concat(stem, F.lit(new))).otherwise(w)).otherwise(out)
    return out


def _plurals(w: Column) -> Column:
    """Step 1a."""
    return F.when(w.endswith("sses") | w.endswith("ies"), _stem_of(w, "es")).when(w.endswith("s") & ~w.endswith("ss"), _stem_of(w, "s")).otherwise(w)


def _tenses(w: Column) -> Column:
    """Step 1b."""
    cut = F.when(w.endswith("ed"), _stem_of(w, "ed")).when(w.endswith("ing"), _stem_of(w, "ing"))
    double = cut.rlike(r"([^aeiouylsz])\1$|yY$")
    mended = (
        F.when(cut.endswith("at") | cut.endswith("bl") | cut.endswith("iz"), F.concat(cut, F.lit("e")))
        .when(double, _stem_of(cut, "x")).when(cut.rlike(_ONE_AND_SHORT), F.concat(cut, F.lit("e"))).otherwise(cut)
    )
    return F.when(w.endswith("eed"), F.when(_stem_of(w, "eed").rlike(_SOME), _stem_of(w, "d")).otherwise(w)).when(cut.rlike(_V), mended).otherwise(w)


def _last_e(w: Column) -> Column:
    """Step 5a."""
    stem = _stem_of(w, "e")
    return F.when(w.endswith("e") & (stem.rlike(_MORE) | (stem.rlike(_ONE) & ~stem.rlike(_SHORT))), stem).otherwise(w)


def porter_stem(word: Column | str) -> Column:
    """The stem of one lower-case word; words of one or two letters stay, and so do words with other signs than a to z
    in them. Null gives null."""
    original = F.col(word) if isinstance(word, str) else word
    w = F.regexp_replace(F.regexp_replace(original, "(^|[aeiou])y", "$1Y"), "yy", "yY")
    steps = (
        _plurals, _tenses, lambda x: F.when(x.rlike("[yY]$") & _stem_of(x, "y").rlike(_V), F.concat(_stem_of(x, "y"), F.lit("i"))).otherwise(x), lambda x: _longest_first(x, STEP_2, _SOME),
        lambda x: _longest_first(x, STEP_3, _SOME), lambda x: _longest_first(x, [(s, "") for s in STEP_4], _MORE), _last_e, lambda x: F.when(x.endswith("ll") & _stem_of(x, "l").rlike(_MORE), _stem_of(x, "l")).otherwise(x),
    )
    for step in steps:
        w = F.get(F.transform(F.array(w), step), F.lit(0))  # each step names its word once, so that it is worked out once
    return F.when(original.rlike("^[a-z]{3,}$"), F.lower(w)).otherwise(original)


def stems(tokens: DataFrame, column: str, lemmas: DataFrame | None = None) -> DataFrame:
    """Distinct words of an array column with what they become: word, stem. With `lemmas` (word, lemma) a word that the
    table has becomes its lemma, the least if there are several, before it is stemmed."""
    words = tokens.select(F.explode(column).alias("word")).where("word is not null").distinct()
    if lemmas is not None:
        one = lemmas.where("lemma is not null").groupBy("word").agg(F.min("lemma").alias("_lemma"))
        words = words.join(one, "word", "left")
        return words.select("word", porter_stem(F.coalesce("_lemma", "word")).alias("stem"))
    return words.select("word", porter_stem("word").alias("stem"))
