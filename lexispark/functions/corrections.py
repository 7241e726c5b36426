"""Corrections mined from reviewed texts, and known expansions joined (survey T6, T7, T8, T11)."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NO_CHANGE = "NoChange"


def join_expansions(c: Column | str, expansions: Iterable[str], low: int = 2, high: int = 6) -> Column:
    """Each n-gram of words that is a known expansion gets underscores for blanks, shorter n-grams first."""
    known = {e for e in expansions if low <= len(e.split()) <= high}

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        words, out = text.split(), text
        for n in range(low, high + 1):
            for gram in (" ".join(words[i : i + n]) for i in range(len(words) - n + 1)):
                if gram in known:
                    out = out.replace(gram, gram.replace(" ", "_"))
        return out

    return F.pandas_udf(lambda s: pd.Series([one(x) for x in s], dtype="object"), "string")(c)


def _steps(token: str, target: list[str], j: int) -> list[tuple[str, int, tuple[int, int]]]:
    """How a token of the normalised text may stand for target words from j on: (kind, words, gain). The gain is one
    kept word, or one changed word; kept words count first."""
    parts, found = token.split("_"), []
    if token == target[j] or (len(parts) > 1 and "".join(parts) == target[j]):
        found.append(("kept", 1, (1, 0)))
    if len(parts) > 1 and target[j : j + len(parts)] == parts:
        found.append(("kept", len(parts), (1, 0)))
    if not found and not token.isdigit():
        initials, there = [p[:1] for p in parts if p], [t[:1] for t in target[j : j + len(parts)]]
        if initials and initials == there:
            found.append(("changed", len(parts), (0, 1)))
    return found


def aligned(tokens: list[str], target: list[str]) -> list[tuple[str, int, int, int]]:
    """The best alignment of two texts that keeps their order: most kept words, then most changed ones, each with
    words of the same initials; the first such words among equals. Steps (kind, token, target, words): kept, changed,
    lost (a token without counterpart) and new (a target word without one), lost ones before new ones."""
    n, m = len(tokens), len(target)
    gain = [[(0, 0)] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            ways = [gain[i + 1][j], gain[i][j + 1]]
            ways += [(g[0] + gain[i + 1][j + w][0], g[1] + gain[i + 1][j + w][1]) for _, w, g in _steps(tokens[i], target, j)]
            gain[i][j] = max(ways)
    path, i, j = [], 0, 0
    while i < n or j < m:
        step = None
        if i < n and j < m:
            step = next(((k, w) for k, w, g in _steps(tokens[i], target, j) if (g[0] + gain[i + 1][j + w][0], g[1] + gain[i + 1][j + w][1]) == gain[i][j]), None)
        if step:
            path.append((step[0], i, j, step[1]))
            i, j = i + 1, j + step[1]
        elif i < n and gain[i + 1][j] == gain[i][j]:
            path.append(("lost", i, j, 0))
            i += 1
        else:
            path.append(("new", i, j, 1))
            j += 1
    return path


def mine(original: str, norm: str, changes: str | None, corrected: str, expansions: dict[str, list[str]] | None = None) -> tuple[str | None, str | None]:
    """Abbreviations and spellings, as `orig:new;` lists, that lead from the normalised to the corrected text.

    The texts are aligned word by word (aligned()). A changed word gives a change; a lost one changes to NO_CHANGE; a
    new word that the original has not either joins the change before it with an underscore. Single signs and lost
    numbers give nothing. A change starts from the word that the normaliser had replaced, where `changes` tells.
    `expansions` maps an expansion to its abbreviations: a change of one whose abbreviation is in the original is an
    abbreviation, and so is every change that has an underscore; these follow the others."""
    original, norm = original.lower(), norm.lower().replace("/", " ")
    target = re.sub("[^a-z0-9+%.>/&]", " ", corrected.lower()).replace("/", " ").split()
    tokens, own = [t for t in norm.split() if len(t) > 1], set(original.split())
    before = {new: old for old, _, new in (pair.partition(":") for pair in (changes or "").split("||")) if new}
    found: list[list[str]] = []  # [list, word, change]
    for kind, i, j, width in aligned(tokens, target):
        if kind == "new":
            if found and target[j] not in own:
                found[-1][2] = target[j] if found[-1][2] == NO_CHANGE else f"{found[-1][2]}_{target[j]}"
        elif kind != "kept" and not tokens[i].isdigit():
            change = "_".join(target[j : j + width]) if kind == "changed" else NO_CHANGE
            short = next((x for x in (expansions or {}).get(tokens[i], []) if x.lower() in original), None)
            found.append(["known" if short else "spelling", short or before.get(tokens[i], tokens[i]), change])
    known = [c for c in found if c[0] == "known"]
    joined = [c for c in found if c[0] == "spelling" and "_" in c[1] + c[2]]
    spellings = [c for c in found if c[0] == "spelling" and "_" not in c[1] + c[2]]
    said = lambda rows: "".join(f"{a}:{b};" for _, a, b in rows) or None
    return said(known + joined), said(spellings)


def surround(changes: str | None, original: str) -> str:
    """Each change with the word after its original token, or before it if that is the last; '' if not found."""
    out = []
    for change in filter(None, (changes or "").split(";")):
        token, near = change.split(":")[0], ""
        for words in (original.split(" "), re.split("[/ ]", original)):
            if token in words:
                i = words.index(token)
                near = words[i + 1] if i + 1 < len(words) else words[i - 1] if len(words) > 1 else ""
                break
        out.append(f"{change}:{near}")
    return ";".join(out)


def mined_changes(df: DataFrame, expansions: dict[str, list[str]] | None = None) -> DataFrame:
    """T7 and T8 over columns original, norm, changes, corrected: adds abbreviations and spellings, with the words
    around. A null original, norm or corrected text gives empty strings."""

    def run(batches):
        for pdf in batches:
            found = [("", "") if None in (o, n, c) else tuple(surround(x, o) for x in mine(o, n, ch, c, expansions)) for o, n, ch, c in zip(pdf["original"], pdf["norm"], pdf["changes"], pdf["corrected"])]
            yield pdf.assign(abbreviations=[a for a, _ in found], spellings=[s for _, s in found])

    return df.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", abbreviations string, spellings string")


def change_rows(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """One row (word, match, surrounding_word, ...) for each change in the column, but those that change nothing."""
    one = df.select(F.explode(F.filter(F.split(column, ";"), lambda c: c != "")).alias("c"), *keep)
    part = lambda i: F.coalesce(F.get(F.split("c", ":"), F.lit(i)), F.lit(""))
    rows = one.select(part(0).alias("word"), part(1).alias("match"), part(2).alias("surrounding_word"), *keep)
    return rows.where(F.col("match") != NO_CHANGE)


class MineCorrections:
    """mine_corrections(original, norm, changes, corrected, expansions): one row (abbreviations, spellings) for each call,
    as mined_changes() gives them; expansions, a map of arrays, may be null."""

    def eval(self, original: str, norm: str, changes: str, corrected: str, expansions: dict = None):
        if None in (original, norm, corrected):
            yield "", ""
        else:
            yield tuple(surround(x, original) for x in mine(original, norm, changes, corrected, expansions))


def register(spark: SparkSession) -> None:
    """mine_corrections for lateral joins in SQL."""
    spark.udtf.register("mine_corrections", F.udtf(MineCorrections, returnType="abbreviations string, spellings string"))
