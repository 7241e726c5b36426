"""Document fingerprints by consistent weighted sampling."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import in_batches, text_of

#: Samples of a fingerprint. The share that two fingerprints have alike is off by about 1 / (2 * sqrt(SAMPLES)).
SAMPLES = 128
#: Terms with their weight whose samples a worker works out, or compares, at once; and whose samples it keeps.
_AT_ONCE, _KEEP = 1024, 100_000
_u = np.uint64
_EACH = np.arange(SAMPLES)
_SEEDS = (np.arange(SAMPLES, dtype=np.uint64) + _u(1)) * _u(0x9E3779B97F4A7C15)


def _draws(terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each term hash and sample: r and ln c, with r and c of the gamma distribution (2, 1), and beta, uniform.

    Each comes from 64 bits of the term and the sample: a sum of two exponential draws has that distribution."""
    with np.errstate(over="ignore"):
        h = terms[:, None] ^ _SEEDS
        for by in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
            h ^= h >> _u(31)
            h *= _u(by)
        h ^= h >> _u(31)
        beta = ((h * _u(0xD6E8FEB86659FD93)) >> _u(40)).astype(np.float32)
    beta *= np.float32(2.0**-24)
    uniform = h.view(np.uint16).astype(np.float32)
    uniform += np.float32(0.5)
    drawn = uniform[:, ::2] * uniform[:, 1::2]
    drawn *= np.float32(2.0**-32)
    np.negative(np.log(drawn, out=drawn), out=drawn)
    return drawn[:, ::2], np.log(drawn[:, 1::2]), beta


def terms(text: str) -> Counter[str]:
    """A text's terms: its words in lower case, with how often they occur."""
    return Counter(text.lower().split())


def weights(text: str) -> dict[str, float]:
    """The weight of each term: how many of the text's characters it makes up."""
    return {w: float(n * len(w)) for w, n in terms(text).items()}


class Sampler:
    """Samples of weighted term sets. Of term t with weight w, sample k is the level floor(ln w / r + beta) and the key
    ln c - r * (level - beta) - r; the set's sample is the least key's (term, level). Equal samples have the likelihood
    of the generalised Jaccard similarity. A term of one weight always has the same samples, so they are worked out once and
    kept."""

    def __init__(self):
        self.place: dict[str | tuple[str, int], int] = {}  # by term and count; by the term alone for a count of 1
        self.keys = np.zeros((0, SAMPLES), np.float32)
        self.marks = np.zeros((0, SAMPLES), np.uint16)
        self.room = np.empty((_AT_ONCE, SAMPLES), np.float32)
        self.size = 0

    def _learn(self, new: list) -> None:
        while self.size + len(new) > len(self.keys):
            grow = max(_AT_ONCE, len(self.keys))  # twice _KEEP rows at most
            self.keys = np.concatenate([self.keys, np.zeros((grow, SAMPLES), np.float32)])
            self.marks = np.concatenate([self.marks, np.zeros((grow, SAMPLES), np.uint16)])
        for at in range(0, len(new), _AT_ONCE):
            some = new[at : at + _AT_ONCE]
            pairs = [(t, 1) if type(t) is str else t for t in some]
            hashes = np.array([xxhash.xxh64_intdigest(t) for t, _ in pairs], dtype=np.uint64)
            r, c, beta = _draws(hashes)
            level = np.log(np.array([n * len(t) for t, n in pairs], np.float32))[:, None] / r
            level += beta
            np.floor(level, out=level)
            a, z = self.size, self.size + len(some)
            with np.errstate(over="ignore"):
                mark = level.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1)
                mark ^= (hashes >> _u(32)).astype(np.uint32)[:, None]
                mark *= np.uint32(0x85EBCA77)
            self.marks[a:z] = mark.view(np.uint16)[:, 1::2]
            level -= beta
            level += np.float32(1)
            level *= r
            np.subtract(c, level, out=self.keys[a:z])
            self.place.update(zip(some, range(a, z)))
            self.size = z

    def __call__(self, found: Counter[str]) -> np.ndarray:
        """SAMPLES marks of 16 bits for terms and how often they occur; all 0 for no terms."""
        out = np.zeros(SAMPLES, np.uint16)
        if not found:
            return out
        best = np.full(SAMPLES, np.inf, np.float32)
        every = [t if n == 1 else (t, n) for t, n in found.items()]
        for begin in range(0, len(every), _KEEP // 2):
            some = every[begin : begin + _KEEP // 2]
            at = list(map(self.place.get, some))
            if None in at:
                new = [x for x, i in zip(some, at) if i is None]
                if self.size + len(new) > _KEEP:
                    self.place.clear()
                    self.size, new, at = 0, some, [None] * len(some)
                fresh = iter(range(self.size, self.size + len(new)))
                self._learn(new)
                at = [next(fresh) if i is None else i for i in at]
            at = np.array(at)
            for s in range(0, len(at), _AT_ONCE):
                some = at[s : s + _AT_ONCE]
                key = np.take(self.keys, some, axis=0, out=self.room[: len(some)], mode="clip")
                least = key.argmin(axis=0)
                value = key[least, _EACH]
                better = np.nonzero(value < best)[0]
                best[better] = value[better]
                out[better] = self.marks[some[least[better]], better]
        return out


@lru_cache(1)
def _sampler() -> Sampler:
    return Sampler()


def fingerprint(text: str) -> np.ndarray:
    return _sampler()(terms(text))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal samples; two empty texts are alike, an empty one is like no other."""
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The text with its last third, in code points, replaced by as many from the start of the following one."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, each group closed by the row that follows its last one (a stranger to the group)."""
    group, last = None, None
    for b in batches:
        rows = []
        for part, doc, text, stranger in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist()):
            text = text.as_py()
            mark = fingerprint(text)
            if part == group and last is not None:
                doc0, text0, mark0 = last
                changed = edited(text0, text)
                other = fingerprint(changed)
                rows.append((doc0, len(text0), hashlib.sha256(changed.encode("utf-8")).hexdigest(), mark0.astype(">u2").tobytes().hex(), other.astype(">u2").tobytes().hex(), likeness(mark0, other), likeness(mark0, mark)))
            group, last = part, None if stranger else (doc, text, mark)
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        columns = list(zip(*rows)) or [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def fingerprint_report(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row.

    The next document is that of the next smaller doc_id; rows that repeat a doc_id stand by a hash of their texts; a
    null doc_id comes after all others; after the last comes the first, so a single row is its own next. A null text
    is empty; empty texts have equal fingerprints, unlike all others; other columns are ignored; no rows, no rows.

    The table is cut by quantiles of doc_id into ranges, and rows without one by their hash. Each range also gets the
    first row of the range after it, so that it can be read alone, in order, with two texts in hand at any time. A
    range is a partition; texts are shuffled once. The driver gets the cuts and a number for each range."""
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    ranges = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ids = d.select("doc_id")
    rows, known = ids.agg(F.count("*"), F.count("doc_id")).first()
    quantiles = ids.where(F.col("doc_id").isNotNull()).approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.25 / ranges) if ranges > 1 else []
    cuts = np.array(sorted({int(x) for x in quantiles}), dtype=np.int64)
    nameless = 1 + (rows - known) * ranges // max(1, rows)

    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(len(cuts) - np.searchsorted(cuts, ids.to_numpy(), side="right"))

    by_id = F.pandas_udf(range_of, "long")(F.coalesce("doc_id", F.lit(0)))
    by_tie = len(cuts) + 1 + F.least(F.lit(nameless - 1), F.floor((F.col("tie").cast("double") / 2.0**64 + 0.5) * nameless))
    d = d.withColumn("tie", F.xxhash64("text")).withColumn("part", F.when(F.col("doc_id").isNull(), by_tie).otherwise(by_id).cast("int"))
    # the first row of each range goes to the range before it as well, that of the first to the last
    first = d.groupBy("part").agg(F.max(F.struct("doc_id", F.bitwise_not("tie").alias("tie"))).alias("f")).collect()
    if not first:
        return d.select("part", "doc_id", "text", F.lit(False).alias("stranger")).mapInArrow(_pairs, _SCHEMA)
    first.sort(key=lambda r: r.part)
    before = [(r.part, r.f.doc_id, ~r.f.tie, first[i - 1].part) for i, r in enumerate(first)]
    table = F.broadcast(spark.createDataFrame(before, "h_part int, h_doc long, h_tie long, to_part int"))
    strangers = d.join(table, (F.col("part") == F.col("h_part")) & F.col("doc_id").eqNullSafe(F.col("h_doc")) & (F.col("tie") == F.col("h_tie")))
    strangers = strangers.select(F.col("to_part").alias("part"), "doc_id", "text", F.lit(True).alias("stranger"), "tie").dropDuplicates(["part"])
    rows = d.select("part", "doc_id", "text", F.lit(False).alias("stranger"), "tie").unionByName(strangers)
    rows = rows.repartitionById(first[-1].part + 1, "part").sortWithinPartitions("part", "stranger", F.col("doc_id").desc_nulls_last(), "tie")
    return in_batches(rows.select("part", "doc_id", "text", "stranger"), _pairs, _SCHEMA)


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
