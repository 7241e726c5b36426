"""Text cleaning, tokens and features as Column functions (survey T1 to T15)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexispark.functions.stems import porter_stem


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_key(c: Column | str) -> Column:
    """A digest of 128 bits by which whole texts are joined and counted, so that texts need not be dealt out."""
    return F.unhex(F.md5(_c(c)))


def charset_clean(c: Column | str) -> Column:
    """Other signs than the allowed ones become blanks, runs of blanks one blank; ends are not trimmed."""
    return F.regexp_replace(_c(c), "[^A-Za-z0-9+%.>/&]+", " ")  # a blank is none of the allowed signs


def strip_lead(c: Column | str) -> Column:
    """A leading `HB ` or `HC ` goes."""
    return F.regexp_replace(_c(c), "^(HB|HC) ", "")


def line_clean(c: Column | str) -> Column:
    """quotes, commas and line ends become blanks; the ends are trimmed of blanks."""
    return F.trim(F.translate(_c(c), '",\r\n', "    "))


# Common English words that carry no class.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself he him his himself she her hers herself it its itself they them their theirs "
    "themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and "
    "but if or because as until while of at by for with about against between into through during before after above below to from up down in "
    "out on off over under again further then once here there when where why how all any both each few more most other some such no nor not "
    "only own same so than too very can will just should now"
).split(" ")


def stop_words(language: str = "english") -> list[str]:
    """The English list above; other languages' from Spark's remover, which needs a running session."""
    return list(STOP_WORDS) if language == "english" else StopWordsRemover.loadDefaultStopWords(language)


def sentence_tokens(c: Column | str, stop: Iterable[str] = (), letters_only: bool = False, stem: bool = False) -> Column:
    """Lower-case tokens without stop words; one with a slash and no digit is split on it. Texts that start with
    `==` have none. letters_only is the cleaning option: all but letters and underscores become blanks first. stem puts
    stems in the place of words, within the row; stems.stems() does each distinct word once, with lemmas if wanted."""
    text = _c(c)
    heading = text.startswith("==")
    text = F.lower(text)
    if letters_only:
        text = F.regexp_replace(text, "[^a-z_]", " ")
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    unwanted = sorted(set(stop))
    if unwanted:
        words = F.filter(words, lambda w: ~w.isin(unwanted))
    parts = F.transform(words, lambda w: F.when(w.contains("/") & ~w.rlike("[0-9]"), F.filter(F.split(w, "/"), lambda p: p != "")).otherwise(F.array(w)))
    tokens = F.flatten(parts)
    return F.when(heading, F.array().cast("array<string>")).otherwise(F.transform(tokens, porter_stem) if stem else tokens)


def normalized(c: Column | str | None, original: Column | str, stop: Iterable[str] = ()) -> Column:
    """T4: the tokens of T3 joined by blanks; without a normalised column, the original in lower case."""
    return F.lower(_c(original)) if c is None else F.array_join(sentence_tokens(c, stop), " ")


def word_grams(c: Column | str, low: int = 2, high: int = 6) -> Column:
    """T5: all word n-grams of low to high words, shorter ones first."""
    words = F.filter(F.split(_c(c), r"\s+"), lambda w: w != "")

    def of(n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))

    return F.concat(*(of(n) for n in range(low, high + 1)))


def feature_tokens(norm: Column | str, original: Column | str, abbreviations: Column | None = None, important: Sequence[str] = (), number: int = 4, width: int = 50) -> Column:
    """Up to `number` feature words, padded with ''. Digits alone go; of more than `number` words only important
    ones stay, if there are any; each once, in order of first occurrence; split on slashes unless it has a digit;
    an expansion becomes its abbreviation (map expansion -> array of abbreviations) if that is a word of the original.
    Cut to `width` characters."""
    words = F.filter(F.split(_c(norm), r"\s+"), lambda w: (w != "") & ~w.rlike("^[0-9]+$"))
    if important:
        kept = F.filter(words, lambda w: w.isin(list(important)))
        words = F.when((F.size(words) > number) & (F.size(kept) > 0), kept).otherwise(words)
    words = F.flatten(F.transform(F.array_distinct(words), lambda w: F.when(w.rlike("[0-9]"), F.array(w)).otherwise(F.split(w, "/"))))
    if abbreviations is not None:
        own = F.split(F.lower(_c(original)), " ")

        def short(w: Column) -> Column:
            known = F.filter(F.coalesce(F.try_element_at(abbreviations, w), F.array().cast("array<string>")), lambda a: F.array_contains(own, F.lower(a)))
            return F.when(F.size(known) > 0, F.lower(F.get(known, F.lit(0)))).otherwise(w)

        words = F.transform(words, short)
    return F.transform(F.sequence(F.lit(0), F.lit(number - 1)), lambda i: F.substring(F.coalesce(F.get(words, i), F.lit("")), 1, width))


def report_cut(norm: Column | str, changes: Column | str) -> tuple[Column, Column]:
    """The normalised text and its changes as a report holds them, 255 and 400 characters long at most."""
    return F.substring(_c(norm), 1, 255), F.substring(_c(changes), 1, 400)


def change_map(c: Column | str) -> Column:
    """`a:b||c:d` as a map from b to a; a later pair wins. Null gives null."""
    pairs = F.filter(F.split(_c(c), r"\|\|"), lambda p: (F.length(p) > 1) & p.contains(":"))
    entry = F.transform(pairs, lambda p: F.struct(F.get(F.split(p, ":"), F.lit(1)).alias("key"), F.get(F.split(p, ":"), F.lit(0)).alias("value")))
    last = F.filter(entry, lambda e, i: ~F.exists(F.slice(entry, i + 2, F.size(entry)), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(last)


def latin1_recoded(c: Column | str) -> Column:
    """Bytes in Latin-1 as text; quotes and tabs go. A string column stands for its bytes."""
    return F.translate(F.decode(_c(c).cast("binary"), "ISO-8859-1"), '"\t', "")


# Phrases of case notes, and what they become.
PHRASES = (
    ("weather related yes", ". This claim is related to weather."), ("weather related y", ". This claim is related to weather."), ("weather related no", ""), ("weather related n", ""),
    ("weather related", ""), ("additional involved parties none", ""), ("additional involved parties", "."),
)


def document_clean(c: Column | str, phrases: Sequence[tuple[str, str]] = ()) -> Column:
    """Addresses, numbers, currency signs, all but ASCII and punctuation go; blanks are joined. With `phrases`, say
    PHRASES, the text is then put in lower case and they are replaced one after the other."""
    # an address begins where its run of signs does, or where the last one ended, so a run is not tried from each sign
    address = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+"
    steps = ((r"[^\x00-\x7F]+", ""), (r"https?://[^ \t\n\r]+", " "), (address, " "), (r"[+]?[0-9][0-9() .-]{6,}[0-9]", " "), (r"[^A-Za-z]+", " "))
    out = _c(c)
    for pattern, new in steps:
        out = F.regexp_replace(out, pattern, new)
    out = F.trim(F.lower(out) if phrases else out)
    for phrase, new in phrases:
        out = F.replace(out, F.lit(phrase), F.lit(new))
    return out


def corpus_tokens(c: Column | str) -> Column:
    """Letters alone, lower case, split."""
    return F.filter(F.split(F.lower(F.regexp_replace(_c(c), "[^a-zA-Z]+", " ")), " "), lambda w: w != "")


def correction_clean(c: Column | str) -> Column:
    """Commas become blanks, runs of blanks one."""
    return F.regexp_replace(F.regexp_replace(_c(c), ",", " "), " {2,}", " ")


def reverse_key(c: Column | str) -> Column:
    """Lower case, trimmed, blanks as underscores."""
    return F.regexp_replace(F.trim(F.lower(_c(c))), " ", "_")
