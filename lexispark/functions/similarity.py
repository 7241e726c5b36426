"""Jaro and Damerau-Levenshtein similarity (survey D1, D2)."""

from __future__ import annotations

import re
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lexispark.functions import corrections
from lexispark.functions.text import charset_clean

_SIGNS, _BLANKS = re.compile("[^A-Za-z0-9+%.>/&]"), re.compile(" +")


def match_text(c: Column | str) -> Column:
    """What is compared: allowed signs alone, no blanks; case counts."""
    return F.regexp_replace(charset_clean(c), " ", "")


def cleaned(s: str) -> str:
    return _BLANKS.sub("", _SIGNS.sub(" ", s))


def jaro(a: str, b: str) -> float:
    """Plain Jaro similarity; 0 if either is empty."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, mine = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                mine.append(x)
                break
    m = len(mine)
    if not m:
        return 0.0
    moved = sum(x != y for x, y in zip(mine, (b[j] for j in range(len(b)) if used[j]))) // 2
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def jaro_many(a: str, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """jaro() of one text to several at once: `codes` has the code points of each in a row, 0 behind its end, and `sizes`
    their lengths. One step for each sign of the text: the first free place within reach that has it, in all texts."""
    own, (number, width) = np.frombuffer(a.encode("utf-32-le"), dtype=np.uint32), codes.shape
    if not len(own) or not width:
        return np.zeros(number)
    reach = np.maximum(np.maximum(sizes, len(own)) // 2 - 1, 0)
    places, every = np.arange(width), np.arange(number)
    free = places < sizes[:, None]
    taken = np.zeros((number, len(own)), dtype=bool)
    most = int(reach.max(initial=0))
    for i, sign in enumerate(own):
        low, high = max(0, i - most), min(width, i + most + 1)
        if low >= high:
            break
        found = (codes[:, low:high] == sign) & free[:, low:high] & (np.abs(places[low:high] - i) <= reach[:, None])
        first = found.argmax(axis=1)
        hit = found[every, first]
        free[every[hit], first[hit] + low] = False
        taken[hit, i] = True
    used = (places < sizes[:, None]) & ~free
    m = taken.sum(axis=1)
    # the signs that match, in the order of either text, a row for each pair
    mine, theirs = np.zeros((number, len(own)), dtype=np.uint32), np.zeros((number, len(own)), dtype=np.uint32)
    k, i = np.nonzero(taken)
    rank = np.arange(len(k)) - np.repeat(np.cumsum(m) - m, m)
    mine[k, rank] = own[i]
    k, j = np.nonzero(used)
    theirs[k, rank] = codes[k, j]
    moved = (mine != theirs).sum(axis=1) // 2
    some = np.maximum(m, 1)
    out = (m / len(own) + m / np.maximum(sizes, 1) + (m - moved) / some) / 3
    return np.where(m > 0, out, 0.0)


#: [k] has the k lowest bits.
_LOW = np.array([(1 << k) - 1 for k in range(65)], dtype=np.uint64)


class Places:
    """Texts of up to 64 signs as the places of each sign, a bit for each, for jaro() of one text to several of them.
    `codes` and `sizes` are those of jaro_many()."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray):
        self.sizes, self.of = sizes.astype(np.int64), {}
        for sign in np.unique(codes[np.arange(codes.shape[1]) < sizes[:, None]]).tolist():
            self.of[sign] = ((codes == sign) & (np.arange(codes.shape[1]) < sizes[:, None])) @ (np.uint64(1) << np.arange(codes.shape[1], dtype=np.uint64))
        self.none = np.zeros(len(sizes), dtype=np.uint64)

    def jaro(self, a: str, some: np.ndarray) -> np.ndarray:
        own, sizes = np.frombuffer(a.encode("utf-32-le"), dtype=np.uint32).tolist(), self.sizes[some]
        if not own:
            return np.zeros(len(some))
        at = {sign: self.of.get(sign, self.none)[some] for sign in set(own)}
        reach = np.maximum(np.maximum(np.arange(65), len(own)) // 2 - 1, 0)  # by size
        used, taken, m = np.zeros(len(some), dtype=np.uint64), [], np.zeros(len(some), dtype=np.int64)
        for i, sign in enumerate(own):
            near = _LOW[np.minimum(i + reach + 1, 64)] & ~_LOW[np.clip(i - reach, 0, 64)]
            free = at[sign] & ~used & near[sizes]
            used |= free & (~free + np.uint64(1))  # the first free place
            taken.append(free != 0)
            m += taken[-1]
        moved = np.zeros(len(some), dtype=np.int64)
        for hit, sign in zip(taken, own):  # the signs that match, in the order of either text
            first = used & (~used + np.uint64(1)) & -hit.astype(np.uint64)
            used ^= first
            moved += hit & ((at[sign] & first) == 0)
        moved //= 2
        out = (m / len(own) + m / np.maximum(sizes, 1) + (m - moved) / np.maximum(m, 1)) / 3
        return np.where(m > 0, out, 0.0)


def damerau_levenshtein(a: str, b: str) -> int:
    """Unrestricted distance: insert, delete, replace, and transpose with edits between. Row by row over the prefixes
    of a; all rows are kept, as a transposition may reach back to any of them."""
    if a == b:
        return 0
    last_row, rows = {}, [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row, upper, last_column = [i], rows[-1], 0
        for j, y in enumerate(b, 1):
            if x == y:
                best = upper[j - 1]
            else:
                best = min(upper[j - 1], upper[j], row[-1]) + 1
            seen = last_row.get(y, 0)
            if seen and last_column:
                best = min(best, rows[seen - 1][last_column - 1] + (i - seen - 1) + 1 + (j - last_column - 1))
            row.append(best)
            if x == y:
                last_column = j
        rows.append(row)
        last_row[x] = i
    return rows[-1][-1]


def damerau_levenshtein_many(a: str, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """damerau_levenshtein() of one text to several at once: `codes` has the code points of each in a row, 0 behind its
    end, and `sizes` their lengths. One step for each pair of places, over all texts."""
    own, mine = np.unique(np.frombuffer(a.encode("utf-32-le"), dtype=np.uint32), return_inverse=True)
    number, width = codes.shape
    if not len(a) or not width:
        return np.maximum(sizes, len(a))
    at = np.minimum(np.searchsorted(own, codes), len(own) - 1)
    signs = np.where(own[at] == codes, at + 1, 0)  # 0 stands for all that the text has not
    far, every = len(a) + width, np.arange(number)
    d = np.full((len(a) + 2, width + 2, number), far, dtype=np.int32)
    d[1:, 1] = np.arange(len(a) + 1)[:, None]
    d[1, 1:] = np.arange(width + 1)[:, None]
    row_of = np.zeros(len(own) + 1, dtype=np.int64)
    for i in range(1, len(a) + 1):
        column, sign = np.zeros(number, dtype=np.int64), mine[i - 1] + 1
        for j in range(1, width + 1):
            row, same = row_of[signs[:, j - 1]], signs[:, j - 1] == sign
            swap = d[row, column, every] + (i - row) + (j - column) - 1
            d[i + 1, j + 1] = np.minimum(np.minimum(d[i, j] + ~same, np.minimum(d[i + 1, j], d[i, j + 1]) + 1), swap)
            column[same] = j
        row_of[sign] = i
    return d[len(a) + 1, sizes + 1, every]


class Prefixes:
    """Texts as a tree of their prefixes, for damerau_levenshtein() of one text to all of them: what they begin with alike
    is worked out once. `codes` and `sizes` are those of damerau_levenshtein_many(). Place 0 stands for no prefix, 1 for the
    empty one; the others go by length."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray):
        number, width = codes.shape
        order = np.lexsort(codes.T[::-1]) if width else np.arange(number)
        codes, sizes = codes[order].astype(np.int64), sizes[order]
        new = np.arange(width) < sizes[:, None]
        new[1:] &= np.logical_or.accumulate(codes[1:] != codes[:-1], axis=1)
        ends = 2 + np.concatenate([[0], np.cumsum(new.sum(axis=0))])
        places = ends[:-1] + np.cumsum(new, axis=0) - 1
        level, text = np.nonzero(new.T)
        self.parent = np.concatenate([[0, 0], np.where(level > 0, places[text, level - 1], 1)])
        self.sign = np.concatenate([[-1, -1], codes[text, level]])
        self.depth = np.concatenate([[0, 0], level + 1]).astype(np.int32)
        self.levels = [slice(a, z) for a, z in zip(ends, ends[1:])]
        self.end, self.width = np.ones(number, dtype=np.int64), width
        some = sizes > 0
        self.end[order[some]] = places[some, sizes[some] - 1]
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def before(self, sign: int) -> tuple[np.ndarray, np.ndarray]:
        """For each prefix the place in it, its last sign aside, that has this sign last (0: none), and the prefix ahead of
        that place."""
        if sign not in self.known:
            if len(self.known) > 200:
                self.known.clear()
            at, ahead = np.zeros(len(self.sign), dtype=np.int32), np.zeros(len(self.sign), dtype=np.int64)
            for own in self.levels[1:]:
                p = self.parent[own]
                hit = self.sign[p] == sign
                at[own], ahead[own] = np.where(hit, self.depth[p], at[p]), np.where(hit, self.parent[p], ahead[p])
            self.known[sign] = at, ahead
        return self.known[sign]

    def distances(self, a: str) -> np.ndarray:
        own = np.frombuffer(a.encode("utf-32-le"), dtype=np.uint32).tolist()
        d = np.full((len(own) + 2, len(self.sign)), len(own) + self.width, dtype=np.int32)
        d[1, 1:] = self.depth[1:]
        row = np.zeros(len(self.sign), dtype=np.int64)
        for i, sign in enumerate(own, 1):
            at, ahead = self.before(sign)
            same = self.sign == sign
            swap = d[row, ahead] + ((i - 1 - row) + (self.depth - at)).astype(np.int32)
            best = np.minimum(np.minimum(d[i, self.parent] + ~same, d[i] + 1), swap)
            now = d[i + 1]
            now[1] = i
            for level in self.levels:
                np.minimum(best[level], now[self.parent[level]] + 1, out=now[level])
            row[same] = i
        return d[len(own) + 1, self.end]


def dl_similarity(a: str, b: str) -> float:
    longest = max(len(a), len(b))
    return 1 - damerau_levenshtein(a, b) / longest if longest else 0.0


def rounded(x: float) -> float:
    """Two decimals, halves up, of the exact binary value."""
    return float(Decimal(x).quantize(Decimal("0.01"), ROUND_HALF_UP))


def _pairwise(measure):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else measure(x, y) for x, y in zip(a, b)], dtype="float64")

    return F.pandas_udf(run, "double")


def jaro_raw(a: Column | str, b: Column | str) -> Column:
    """Unrounded Jaro similarity of cleaned texts; null if either is null."""
    return _pairwise(jaro)(match_text(a), match_text(b))


def dl_raw(a: Column | str, b: Column | str) -> Column:
    return _pairwise(dl_similarity)(match_text(a), match_text(b))


def jaro_similarity(a: Column | str, b: Column | str) -> Column:
    """Jaro similarity of cleaned texts, two decimals."""
    return F.round(jaro_raw(a, b), 2)


def damerau_similarity(a: Column | str, b: Column | str) -> Column:
    """1 - distance / longer length of cleaned texts, two decimals; two empty texts give 0."""
    return F.round(dl_raw(a, b), 2)


def register(spark: SparkSession) -> None:
    """jaro_sim, dl_sim, clean_text and mine_corrections for SQL."""
    corrections.register(spark)
    spark.udf.register("jaro_sim", _pairwise(lambda a, b: rounded(jaro(cleaned(a), cleaned(b)))))
    spark.udf.register("dl_sim", _pairwise(lambda a, b: rounded(dl_similarity(cleaned(a), cleaned(b)))))
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION clean_text(s STRING) RETURNS STRING RETURN regexp_replace(regexp_replace(s, '[^A-Za-z0-9+%.>/&]', ' '), ' {2,}', ' ')")
