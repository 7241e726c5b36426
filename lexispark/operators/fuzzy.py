"""Nearest known texts by Jaro or Damerau-Levenshtein similarity (survey J12 to J14, C1, C2).

Both measures are bounded by the lengths of two texts and by the signs they have in common, whatever their order. From a
similarity on that leaves few texts with enough signs in common a text meets only known ones that share enough of their
rarest signs, found by an inverted index. Else, and where the known texts fit into one block, texts are dealt to blocks of bounded size by length, and a
task holds one block of either. In both ways only pairs that could still win are measured, and each distinct text is
compared once; nothing is broadcast."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexispark.functions.similarity import Places, Prefixes, damerau_levenshtein_many, dl_similarity, jaro, jaro_many, match_text

#: Known texts of a block, and new ones.
BLOCK, NEW = 4000, 500
#: Texts that are measured at once, and the longest for which that is done; bounds the memory of a step to some 20 MB.
AT_ONCE, WIDE = 512, 100
#: Signs of the texts of one tree of prefixes, which is as much memory; the share of a block's texts from which on its trees
#: are quicker than AT_ONCE.
TREE, SHARE = 50_000, 1 / 16
#: Fewer texts are measured one by one.
FEW = 64
_FOLDS = 64
#: Lengths are classed by powers of this.
_STEP = float(np.log(1.3))
#: The least similarity for which an index pays: under it, a third of all pairs have the signs in common that it takes.
#: For Jaro, which allows any order of signs, that is so early.
INDEXED = {"jaro": 0.92, "dl": 0.75}
#: The number of known texts from which on there is an index; partitions over which the candidates of one text are dealt.
INDEX_FROM, SALT = 1000, 8
#: Signs are taken together by threes where so few rare ones matter, by twos where so few.
_THREES, _TWOS = 10, 30


def _signs(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), _FOLDS), dtype=np.int16)
    for i, t in enumerate(texts):
        codes, n = np.unique(np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32) % _FOLDS, return_counts=True)
        out[i, codes] = n
    return out


def _limits(measure: str, common: np.ndarray, size: int, sizes: np.ndarray) -> np.ndarray:
    """The most that the similarity can be, given the signs in common."""
    if not size:
        return np.zeros(len(sizes))
    longest = np.maximum(sizes, size)
    if measure == "jaro":
        return np.where((common > 0) & (sizes > 0), (common / size + common / np.maximum(sizes, 1) + 1) / 3, 0.0)
    return common / longest


def _best(known: pd.DataFrame, new: pd.DataFrame, measure: str, best: bool = False) -> pd.DataFrame:
    """For each new text all known ones of the block that reach its `n_least`, or with `best` the best of these; where that
    is null its best ones.

    Similarities to texts of up to WIDE signs are worked out for several texts at once."""
    texts, sizes = known["k_text"].tolist(), known["k_text"].str.len().to_numpy()
    signs, rows, widest = _signs(texts), [], int(sizes.max(initial=0))
    codes = None
    if widest <= WIDE:
        codes = np.zeros((len(texts), widest), dtype=np.uint32)
        for i, t in enumerate(texts):
            codes[i, : len(t)] = np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32)

    places = Places(codes, sizes) if measure == "jaro" and FEW <= len(texts) and widest <= 64 else None
    trees: list[tuple[np.ndarray, Prefixes]] = []  # made when they are first needed

    def by_trees(text: str, rest: np.ndarray) -> bool:
        return measure != "jaro" and codes is not None and len(text) <= WIDE and len(rest) >= max(FEW, SHARE * len(texts))

    def every_distance(text: str) -> np.ndarray:
        if not trees:
            order = np.lexsort(codes.T[::-1]) if widest else np.arange(len(texts))
            run = np.cumsum(sizes[order]) // TREE
            for own in np.split(order, np.flatnonzero(np.diff(run)) + 1):
                trees.append((own, Prefixes(codes[own], sizes[own])))
        out = np.zeros(len(texts), dtype=np.int64)
        for own, tree in trees:
            out[own] = tree.distances(text)
        return out

    def measured(text: str, some: np.ndarray) -> np.ndarray:
        if codes is None or len(text) > WIDE or len(some) < FEW:
            exact = jaro if measure == "jaro" else dl_similarity
            return np.array([exact(text, texts[i]) for i in some])
        if measure == "jaro":
            return jaro_many(text, codes[some], sizes[some]) if places is None else places.jaro(text, some)
        longest = np.maximum(sizes[some], len(text))
        away = every_distance(text)[some] if by_trees(text, some) else damerau_levenshtein_many(text, codes[some], sizes[some])
        return np.where(longest > 0, 1 - away / np.maximum(longest, 1), 0.0)

    for text, least in zip(new["n_text"], new["n_least"]):
        own, free = _signs([text])[0], least is None or least != least
        best_only = best or free
        limits = np.floor(_limits(measure, np.minimum(signs, own).sum(axis=1), len(text), sizes) * 100 + 0.5 + 1e-9) / 100
        bar, found, order = -1.0 if free else least, [], np.argsort(-limits, kind="stable")
        at, step = 0, 1  # the first ones alone, as they mostly raise the bar above all others
        while at < len(order):
            some, at = order[at : at + step], at + step
            some = some[limits[some] >= bar]
            if not len(some):
                break
            step = 1
            if codes is not None and at >= 8:
                left = order[at:]
                step = len(left) if places is not None or by_trees(text, left[limits[left] >= bar]) else AT_ONCE
            # the same two decimals as round() in SQL gives
            two = np.floor(measured(text, some) * 100 + 0.5 + 1e-9) / 100
            found += [(text, texts[i], float(x)) for i, x in zip(some, two) if x >= bar]
            bar = max(bar, float(two.max())) if best_only else bar
        rows += [r for r in found if r[2] >= bar]
    return pd.DataFrame(rows, columns=["n_text", "k_text", "similarity"]).astype({"n_text": "object", "k_text": "object", "similarity": "float64"})


def _class(c: str) -> Column:
    return F.floor(F.log(F.greatest(F.length(c), F.lit(1)).cast("double")) / _STEP).cast("int")


def _reach(measure: str, least: Column) -> Column:
    """How many classes of length away a text can be that reaches `least`: jaro >= x needs min / max >= 3 x - 2, the
    distance's similarity >= x needs min / max >= x; rounding gives half a point. All classes where that is no bound."""
    ratio = 3 * (least - 0.005) - 2 if measure == "jaro" else least - 0.005
    return F.when(ratio < 0.02, 10_000).otherwise((F.ceil(-F.log(F.greatest(F.lit(0.02), ratio)) / _STEP) + 1).cast("int"))


def _joined(new: DataFrame, known: DataFrame, sizes: dict[int, int], turns: int, measure: str, best: bool = False) -> DataFrame:
    """New texts (n_text, n_least, low, high) against known ones (k_text, size) of the classes low to high."""
    blocks = F.create_map(*(F.lit(x) for s, n in sizes.items() for x in (s, 1 + n // BLOCK)))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    n = new.withColumn("size", F.explode(F.filter(F.array(*map(F.lit, sorted(sizes))), lambda s: s.between(F.col("low"), F.col("high")))))
    n = n.withColumn("turn", F.pmod(F.xxhash64("n_text"), F.lit(turns)).cast("int")).withColumn("salt", every(blocks[F.col("size")]))
    k = known.withColumn("salt", F.pmod(F.xxhash64("k_text"), blocks[F.col("size")]).cast("int")).withColumn("turn", every(F.lit(turns)))
    keys = ["size", "salt", "turn"]
    # by number, as adaptive execution would put blocks that are few bytes, but much work, into one or two tasks
    parts = min(turns * sum(1 + x // BLOCK for x in sizes.values()), 4 * new.sparkSession.sparkContext.defaultParallelism)
    k, n = k.select("k_text", *keys).repartition(parts, *keys), n.select("n_text", "n_least", *keys).repartition(parts, *keys)
    pairs = k.groupBy(*keys).cogroup(n.groupBy(*keys))
    return pairs.applyInPandas(lambda a, b: _best(a, b, measure, best), "n_text string, k_text string, similarity double")


class SignIndex:
    """Keys by which texts of up to WIDE signs meet if their similarity may reach `least`.

    A text's signs, each with the number of its occurrence so far, are a set, whose members are ordered by how few known
    texts have them. Two texts of n and m signs that reach `least` share some c of them at least. So the first j that
    they share are among the first n - c + j of the one and the first m - c + j of the other: each text is listed under
    all subsets of j of those, for each class of lengths that the other may have. j is 3 where that makes few keys, else 2
    or 1. Signs are folded to 64, which can only add candidates. (Pairs of neighbouring signs in their place make more
    candidates, not fewer: an edit undoes three of them, so few need be shared.)"""

    def __init__(self, measure: str, least: float, counts: np.ndarray):
        """counts[sign, k]: how many known texts have the sign more than k times."""
        self.measure, self.least = measure, least - 0.005 - 1e-9  # two decimals
        self.rank = np.empty(counts.size, dtype=np.int64)
        self.rank[np.argsort(counts.ravel(), kind="stable")] = np.arange(counts.size)
        self.class_of = [0, *(int(math.floor(math.log(n) / _STEP + 1e-12)) for n in range(1, WIDE + 1))]
        self.spans: dict[int, tuple[int, int]] = {}
        for n, c in enumerate(self.class_of[1:], 1):
            self.spans[c] = (self.spans.get(c, (n, n))[0], n)
        # of a text of n signs the least share that the other's length can be
        self.ratio = 3 * self.least - 2 if measure == "jaro" else self.least
        self.subsets = {(a, b): self.subset(a, b) for a in self.spans for b in self.spans}

    def shared(self, n: int, m: int) -> int:
        """How many signs texts of these lengths must share."""
        least = (3 * self.least - 1) * n * m / (n + m) if self.measure == "jaro" else self.least * max(n, m)
        return max(1, math.ceil(least - 1e-9))

    def subset(self, a: int, b: int) -> int:
        """How many signs make a key for texts of these two classes."""
        least = self.shared(self.spans[a][0], self.spans[b][0])
        rare = max(self.spans[a][1], self.spans[b][1]) - least
        return min(3 if rare + 3 <= _THREES else 2 if rare + 2 <= _TWOS else 1, least)

    def keys(self, text: str, known: bool) -> list[int]:
        n, seen, signs = len(text), {}, []
        for c in text:
            sign = ord(c) % _FOLDS
            k = seen[sign] = seen.get(sign, -1) + 1
            signs.append(sign * WIDE + k)
        signs, own, out = sorted(self.rank[signs].tolist()), self.class_of[n], []
        for other, (low, high) in self.spans.items():
            low, high = max(low, math.ceil(self.ratio * n - 1e-9)), min(high, math.floor(n / self.ratio + 1e-9))
            if low > high:
                continue
            j = self.subsets[(own, other) if known else (other, own)]
            head = (own << 5 | other if known else other << 5 | own) << 2 | j
            for some in combinations(signs[: n - max(j, self.shared(n, low)) + j], j):
                key = head
                for x in some:
                    key = key << 13 | x
                out.append(key)
        return out


def _sign_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = np.zeros((_FOLDS, WIDE), dtype=np.int64)
    for b in batches:
        held = _signs(b["k_text"].tolist())
        for k in range(int(held.max(initial=0))):
            counts[:, k] += (held > k).sum(axis=0)
    at = np.flatnonzero(counts)
    yield pd.DataFrame({"at": at, "n": counts.ravel()[at]})


def _listed(texts: DataFrame, text: str, index, known: bool) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 500):  # a text has up to some thousand keys
                some = b[text].iloc[at : at + 500]
                keys = [index.value.keys(t, known) for t in some]
                yield pd.DataFrame({"key": np.fromiter((k for own in keys for k in own), np.int64), text: np.repeat(some.to_numpy(dtype=object), [len(own) for own in keys])})

    return texts.select(text).mapInPandas(run, f"key long, {text} string")


def candidates(new: DataFrame, known: DataFrame, measure: str, least: float) -> DataFrame:
    """Pairs (n_text, k_text), some of them several times, of distinct texts of 1 to WIDE signs: all that reach `least`.

    The driver gets the counts of signs, 6400 numbers at most. Lists of a key are joined as they are, so a hot key is
    split by adaptive execution."""
    counts = np.zeros(_FOLDS * WIDE, dtype=np.int64)
    for r in known.select("k_text").mapInPandas(_sign_counts, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        counts[r["at"]] = r["n"]
    index = new.sparkSession.sparkContext.broadcast(SignIndex(measure, least, counts.reshape(_FOLDS, WIDE)))
    return _listed(new, "n_text", index, False).join(_listed(known, "k_text", index, True), "key").select("n_text", "k_text")


def _indexed(new: DataFrame, known: DataFrame, measure: str, least: float, best: bool = False) -> DataFrame:
    """All pairs of candidates() that reach `least`, each once, or with `best` at least each text's best of them; a text's candidates are measured AT_ONCE at a time."""
    pairs = candidates(new, known, measure, least).withColumn("salt", F.pmod(F.xxhash64("k_text"), F.lit(SALT)))
    pairs = pairs.repartition("n_text", "salt").sortWithinPartitions("n_text", "k_text").select("n_text", "k_text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, text, held = (None, None), None, []

        def measured() -> pd.DataFrame:
            return _best(pd.DataFrame({"k_text": held}, dtype=object), pd.DataFrame({"n_text": [text], "n_least": [least]}), measure, best)

        for b in batches:
            for pair in zip(b["n_text"], b["k_text"]):
                if pair == last:
                    continue
                if held and (pair[0] != text or len(held) == AT_ONCE):
                    yield measured()
                    held = []
                last, text = pair, pair[0]
                held.append(pair[1])
        if held:
            yield measured()

    return pairs.mapInPandas(run, "n_text string, k_text string, similarity double")


def matches(new: DataFrame, known: DataFrame, measure: str = "jaro", least: float | None = None, index_from: int = INDEX_FROM, best: bool = False) -> DataFrame:
    """(n_text, k_text, similarity) between the distinct texts of new (n_text) and of known (k_text): all pairs of at
    least that similarity (with `best` each text's best ones, and maybe others), or without `least` each new text's best ones, with all ties.

    More than `index_from` known texts are looked up in an index if `least` is INDEXED or more; texts of over WIDE signs
    go by blocks. Without `least`, and 20 times as many, the texts that have a known one of INDEXED are settled by it. The others are compared with known texts of about their length; the best similarity there bounds the lengths, and the pairs,
    that need be looked at among the others. The driver gets the number of known texts by class of length, some tens of
    rows."""
    n, k = new.select("n_text").where("n_text is not null").distinct(), known.select("k_text").where("k_text is not null").distinct()
    k = k.withColumn("size", _class("k_text"))
    sizes = {r["size"]: r["n"] for r in k.groupBy("size").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return n.join(k.where("false"), F.lit(False)).select("n_text", "k_text", F.lit(0.0).alias("similarity"))
    # a search for the best asks the index only for the few that have a very near one, so it pays later
    turns, by_index = 1 + n.count() // NEW, sum(sizes.values()) > (index_from if least is not None else 20 * index_from)
    own = n.withColumn("own", _class("n_text"))

    def reaching(least: float) -> DataFrame:
        wide = _reach(measure, F.lit(float(least)))
        blocks = lambda new, old: _joined(new.select("n_text", F.lit(float(least)).alias("n_least"), (F.col("own") - wide).alias("low"), (F.col("own") + wide).alias("high")), old, sizes, turns, measure, best)
        if not by_index or least < INDEXED[measure]:
            return blocks(own, k)
        short = lambda c: F.length(c).between(1, WIDE)
        found = _indexed(n.where(short("n_text")), k.where(short("k_text")), measure, least, best)
        long = F.length("n_text") > WIDE  # an empty text is like none
        if max(sizes) >= math.floor(math.log(WIDE) / _STEP):
            found = found.unionByName(blocks(own, k.where(F.length("k_text") > WIDE))).unionByName(blocks(own.where(long), k.where(short("k_text"))))
        return found

    if least is not None:
        return reaching(least)
    sure = None
    if by_index:
        sure = reaching(INDEXED[measure])
        settled = sure.select(F.col("n_text").alias("_s")).distinct()
        own = own.join(settled, F.col("n_text") == F.col("_s"), "left_anti")
    near = F.array_min(F.transform(F.array(*map(F.lit, sorted(sizes))), lambda s: F.struct(F.abs(s - F.col("own")).alias("d"), s.alias("s"))))["s"]
    first = _joined(own.select("n_text", F.lit(None).cast("double").alias("n_least"), near.alias("low"), near.alias("high")), k, sizes, turns, measure)
    bar = first.groupBy("n_text").agg(F.max("similarity").alias("n_least"))
    wide = _reach(measure, F.col("n_least"))
    rest = bar.withColumn("own", _class("n_text")).select("n_text", "n_least", (F.col("own") - wide).alias("low"), (F.col("own") + wide).alias("high"))
    found = _joined(rest, k, sizes, turns, measure)
    found = found if sure is None else found.unionByName(sure)
    top = F.max("similarity").over(W.partitionBy("n_text"))
    return found.withColumn("_top", top).where(F.col("similarity") == F.col("_top")).select("n_text", "k_text", "similarity")


def _known(train: DataFrame, text: str, label: str, order: str) -> DataFrame:
    return train.select(match_text(text).alias("k_text"), F.col(label).alias("k_class"), F.col(order).alias("k_order"), F.col(text).alias("k_desc"))


def nearest(new: DataFrame, train: DataFrame, text: str, label: str, order: str, measure: str = "jaro", least: float | None = None, by_text: bool = False) -> DataFrame:
    """New with the class and similarity of its most similar training row; null where none reaches
    `least`. Ties go to the first in `order`, or by_text to the least description."""
    known = _known(train, text, label, order)
    n = new.withColumn("n_text", match_text(text))
    found = matches(n, known, measure, least, best=True)
    first = ["k_desc", "k_order"] if by_text else ["k_order"]
    one = known.groupBy("k_text").agg(F.min(F.struct(*first, "k_class")).alias("f"))
    best = found.join(one, "k_text").groupBy("n_text").agg(F.min(F.struct((-F.col("similarity")).alias("s"), *(F.col(f"f.{c}").alias(c) for c in first), F.col("f.k_class").alias("k_class"))).alias("b"))
    best = best.select(F.col("n_text").alias("b_text"), F.col("b.k_class").alias("prediction"), (-F.col("b.s")).alias("similarity"))
    return n.join(best, F.col("n_text") == F.col("b_text"), "left").drop("n_text", "b_text")


def boosted(similarity):
    """The score of a fuzzy match: 0.85 up to 0.9 counts as 0.91."""
    return F.when((similarity >= 0.85) & (similarity < 0.9), 0.91).otherwise(similarity)


def unanimous(new: DataFrame, train: DataFrame, text: str, label: str, key: str, least: float = 0.85, measure: str = "jaro") -> DataFrame:
    """For each new row that has matches of at least that similarity: how many training rows match, how many
    classes these have, their mean similarity, and their class if it is but one."""
    known = _known(train, text, label, label)
    n = new.select(key, match_text(text).alias("n_text"))
    sizes = known.groupBy("k_text").agg(F.count("*").alias("k_n"), F.collect_set("k_class").alias("k_classes"))
    found = matches(n, known, measure, least).join(sizes, "k_text")
    per = found.groupBy("n_text").agg(F.sum("k_n").alias("n_matches"), (F.sum(F.col("similarity") * F.col("k_n")) / F.sum("k_n")).alias("mean_similarity"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("k_classes")))).alias("classes"))
    out = n.join(per, "n_text").select(key, F.col("n_matches").cast("long").alias("n_matches"), F.size("classes").cast("long").alias("n_classes"), "mean_similarity", F.when(F.size("classes") == 1, F.get("classes", F.lit(0))).alias("prediction"))
    return out


def exact_matches(new: DataFrame, train: DataFrame, key: list[str]) -> DataFrame:
    """New with the training rows of equal key; several rows of one key give several."""
    return new.join(train, key, "inner")


def unmatched(new: DataFrame, train: DataFrame, key: list[str]) -> DataFrame:
    """New rows whose key no training row has."""
    return new.join(train, key, "left_anti")
