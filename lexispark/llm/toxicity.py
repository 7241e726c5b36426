"""Toxicity: a weighted lexicon, matched by Aho-Corasick on folded text, with exception phrases."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import in_batches, spread, stored, text_of

#: Labelled documents that the lexicon and its scale are learned from, at most; the lowest hashes of doc_id.
LABELLED = 40_000
#: Words that a Python worker counts before it hands their numbers on.
COUNTED = 100_000
#: The least part of a word's clean uses that a phrase must make up to be an exception.
PHRASE = 0.2
# Letters that look like Latin ones, and digits and signs that stand for letters. l and i fold together,
# as 1 stands for either.
HOMOGLYPHS = "аaеeоoрpсcуyхxіiјjѕsԁdԛqԝwһhαaοoνvρpτtυuιiκkɡgıi"
SUBSTITUTES = "0o1i3e4a5s7t8b@a$s|ili"
_FOLD = {ord(x): y for x, y in zip(HOMOGLYPHS[::2], HOMOGLYPHS[1::2])} | {ord(x): y for x, y in zip(SUBSTITUTES[::2], SUBSTITUTES[1::2])}
_FOLD |= {c: chr(c - 0xFEE0) for c in range(0xFF41, 0xFF5B)} | {c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}
_RUN = re.compile(r"[^\W_]+")


def folded(text: str) -> str:
    """Lower case, look-alikes and substitutes as plain letters, invisible marks gone."""
    return text.lower().translate(_FOLD)


def _word_before(text: str, end: int) -> str:
    """The last run of letters and digits before a place."""
    while end and not (text[end - 1].isalnum()):
        end -= 1
    start = end
    while start and text[start - 1].isalnum():
        start -= 1
    return text[start:end]


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: set[str] = field(default_factory=set)
    offset: float = -4.0
    slope: float = 1.0

    def matcher(self):
        import ahocorasick

        auto = ahocorasick.Automaton()
        for word in self.weights:
            auto.add_word(word, word)
        if self.weights:
            auto.make_automaton()
        return auto

    def strength(self, auto, text: str) -> tuple[float, int]:
        """Summed weight of the words found, divided by a slow function of the text's length; and their number.

        A find counts as a whole word only, and not where it stands in an exception phrase: the word with the word
        before or after it."""
        if not self.weights or not text:
            return 0.0, 0
        text, total, n = folded(text), 0.0, 0
        for end, word in auto.iter(text):
            start, after = end + 1 - len(word), end + 1
            if (start and text[start - 1].isalnum()) or (after < len(text) and text[after].isalnum()):
                continue
            if self.exceptions:
                behind = _RUN.search(text, after)
                if f"{_word_before(text, start)} {word}" in self.exceptions or (behind and f"{word} {behind[0]}" in self.exceptions):
                    continue
            total += self.weights[word] ** 2
            n += 1
        return total / (4.0 + np.log2(1 + len(text) / 64)), n

    def score(self, strength: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.offset + self.slope * np.sqrt(strength), -40, 40))))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, kind, mark, n). Kinds 0 and 1: how many clean and toxic texts have the word. Kind 2: one of the contexts
    that it has in toxic texts."""
    texts: Counter[tuple[str, int]] = Counter()
    for b in batches:
        seen = set()
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            words = _RUN.findall(folded(text))
            texts.update((w, toxic) for w in set(words))
            if toxic:
                around = ["", *words, ""]
                seen.update((w, hash_of(around[i], around[i + 2])) for i, w in enumerate(words))
        yield _rows([(w, 2, m, 1) for w, m in seen])
        if len(texts) > COUNTED:
            yield _rows([(w, k, 0, n) for (w, k), n in texts.items()])
            texts.clear()
    yield _rows([(w, k, 0, n) for (w, k), n in texts.items()])


def _rows(rows: list[tuple[str, int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.int64()))], names=["word", "kind", "mark", "n"])


def hash_of(*words: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest("\x00".join(words)) - 2**63


def _phrases(batches: Iterator[pa.RecordBatch], words: set[str]) -> Iterator[pa.RecordBatch]:
    """(phrase, toxic): the words of the lexicon with the word before and the word after, once a text."""
    for b in batches:
        out = []
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            run = _RUN.findall(folded(text))
            found = set()
            for i, w in enumerate(run):
                if w in words:
                    found.update([f"{run[i - 1]} {w}"] if i else [])
                    found.update([f"{w} {run[i + 1]}"] if i + 1 < len(run) else [])
            out += [(p, toxic) for p in found]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.string()), pa.array([t for _, t in out], pa.int32())], names=["phrase", "toxic"])


def _strengths(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    auto = lexicon.matcher()
    for b in batches:
        found = [lexicon.strength(auto, t.as_py()) for t in b.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in found], pa.float64()), b.column(1)], names=["strength", "toxic"])


def _weight(n1: float, n0: float, all1: float, all0: float) -> float:
    """Lower bound of the log odds ratio."""
    ratio = np.log((n1 + 0.5) / (all1 + 1)) - np.log((n0 + 0.5) / (all0 + 1))
    return float(ratio - 1.64 * np.sqrt(1 / (n1 + 0.5) + 1 / (n0 + 0.5)))


def _scale(strengths: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Offset and slope of a logistic curve over sqrt(strength), by Newton's method with a weak prior."""
    x = np.stack([np.ones(len(strengths)), np.sqrt(strengths)], axis=1)
    beta, prior = np.array([-2.0, 1.0]), np.array([-2.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (p - toxic) + 0.5 * (beta - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(2), grad)
        beta = beta - np.clip(step, -1, 1)
    return float(beta[0]), float(max(beta[1], 0.05))


def fit(docs: DataFrame, labels: DataFrame, most: int = LABELLED, support: int = 3, least_weight: float = 1.5) -> Lexicon:
    """Learn the lexicon from at most `most` labelled documents (columns doc_id, toxic of `labels`).

    Two thirds give the words: a word's weight is a cautious log odds ratio of the toxic to the clean texts that have
    it, of the toxic ones no more than the contexts it has there, so that copies of one text count once. Phrases of a word with a neighbour that make up a
    good part of its clean uses and none of its toxic ones become exceptions, which no longer count against the word. The
    last third sets the curve from strength to score. No labels or texts: an empty lexicon and low scores."""
    wanted = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    wanted = wanted.orderBy(F.xxhash64("l_id"), "l_id").limit(most)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    # at most `most` pairs of numbers, so that the texts need not be dealt out
    rows = stored(d.join(F.broadcast(wanted), F.col("doc_id") == F.col("l_id")).select("doc_id", "text", "toxic").repartition(d.sparkSession.sparkContext.defaultParallelism), "labelled")
    part = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(3))
    learn, check = rows.where(part != 0).select("text", "toxic"), rows.where(part == 0).select("text", "toxic")
    totals = learn.agg(F.sum("toxic").alias("n1"), F.count("*").alias("n")).first()
    all1, all0 = totals.n1 or 0, totals.n - (totals.n1 or 0)
    if not all1 or not all0:
        return Lexicon({})
    counts = in_batches(learn, _count, "word string, kind int, mark long, n long").groupBy("word", "kind", "mark").agg(F.sum("n").alias("n"))
    of = lambda kind, x: F.coalesce(F.sum(F.when(F.col("kind") == kind, x)), F.lit(0))
    counts = counts.groupBy("word").agg(of(0, F.col("n")).alias("n0"), F.least(of(1, F.col("n")), of(2, F.lit(1))).alias("n1")).where(F.col("n1") >= support)
    # far more frequent in toxic texts than in clean ones, before exceptions are known
    counts = counts.where((F.col("n1") + 0.5) / (all1 + 1) > 2 * (F.col("n0") + 0.5) / (all0 + 1))
    found = {r.word: (r.n1, r.n0) for r in counts.collect()}
    mixed = {w for w, (_, n0) in found.items() if n0}
    exceptions, spared = set(), Counter()
    if mixed:
        ph = in_batches(learn, partial(_phrases, words=mixed), "phrase string, toxic int").groupBy("phrase").agg(F.sum("toxic").alias("n1"), F.sum(1 - F.col("toxic")).alias("n0"))
        # a phrase that makes up a good part of a word's clean uses, and no toxic one
        for r in ph.where((F.col("n1") == 0) & (F.col("n0") >= support)).collect():
            for w in set(r.phrase.split(" ")) & mixed:
                if r.n0 >= PHRASE * found[w][1]:
                    exceptions.add(r.phrase)
                    spared[w] = max(spared[w], r.n0)
    weights = {w: _weight(n1, max(0, n0 - spared[w]), all1, all0) for w, (n1, n0) in found.items()}
    lexicon = Lexicon({w: x for w, x in weights.items() if x >= least_weight and len(w) > 1}, exceptions)
    scored = in_batches(check, partial(_strengths, lexicon=lexicon), "strength double, toxic int").toPandas()
    if len(scored):
        lexicon.offset, lexicon.slope = _scale(scored["strength"].to_numpy(), scored["toxic"].to_numpy())
    return lexicon


def _score(batches: Iterator[pa.RecordBatch], lexicon: Lexicon, threshold: float) -> Iterator[pa.RecordBatch]:
    auto = lexicon.matcher()
    for b in batches:
        found = [lexicon.strength(auto, t.as_py()) for t in b.column(1)]
        scores = [lexicon.score(s) for s, _ in found]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(2), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array([n for _, n in found], pa.int64())],
            names=["doc_id", "held_out", "score", "predicted", "n_found"],
        )


def held_out() -> Column:
    """Documents that no label is learned from: crc32 of doc_id as text leaves 2 by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train_labels(labels: DataFrame) -> DataFrame:
    return labels.where(~held_out())


def scored(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, n_found for each row.

    A null text is empty and gets the score of no finds; a null doc_id stays null and is not held out; repeated rows
    are scored each; other columns are ignored; no rows give no rows."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    d = spread(d).withColumn("held_out", held_out())
    return in_batches(d, partial(_score, lexicon=lexicon, threshold=threshold), "doc_id long, held_out boolean, score double, predicted int, n_found long")


def _clean(batches: Iterator[pa.RecordBatch], lexicon: Lexicon, threshold: float, column: int) -> Iterator[pa.RecordBatch]:
    auto = lexicon.matcher()
    for b in batches:
        yield b.filter(pa.array([lexicon.score(lexicon.strength(auto, t.as_py() or "")[0]) < threshold for t in b.column(column)], pa.bool_()))


def without_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3) -> DataFrame:
    """docs less the rows whose score reaches the threshold, in docs' columns."""
    return in_batches(spread(docs), partial(_clean, lexicon=lexicon, threshold=threshold, column=docs.columns.index("text")), docs.schema)
