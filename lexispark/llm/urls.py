"""URL filter: rules by host and path, and a character language-model ratio for all other URLs.

The model is a table of exact counts of contexts and of characters in them, which grows with the URLs. URLs are scored
in parts of bounded size, each of which gets the counts of its own contexts by a join."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import in_batches, spread, stored

#: (rule, verdict): host and its subdomains, then the path's start.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: Longest context is ORDERS - 1 bytes. A context weighs as many times as it has been seen, the shorter one STRENGTH.
ORDERS, STRENGTH = 6, 2.0
#: URLs that are scored at once; counts that a worker keeps before it hands them on.
A_PART, COUNTED = 5000, 200_000
#: Scores are counted in BINS steps of width STEP around 0 to calibrate the threshold.
BINS, STEP = 4001, 0.005


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    found = verdict = F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: len(r[0])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        found, verdict = F.when(fits, F.lit(rule)).otherwise(found), F.when(fits, F.lit(says)).otherwise(verdict)
    return found, verdict


def contexts(url: str) -> list[tuple[list[bytes], bytes]]:
    """Each byte of a URL and of the mark that ends it, with the 0 to ORDERS - 1 bytes before it, shortest first; a URL
    starts after blanks."""
    raw = b"\x00" * (ORDERS - 1) + url.encode("utf-8", "surrogatepass") + b"\x03"
    return [([raw[i - k : i] for k in range(ORDERS)], raw[i : i + 1]) for i in range(ORDERS - 1, len(raw))]


def grams(url: str) -> Iterator[bytes]:
    """The keys of the counts that a URL adds to: a context alone, and with the byte that follows, told apart by their
    first byte."""
    for before, byte in contexts(url):
        for context in before:
            yield b"\x00" + context
            yield b"\x01" + context + byte


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, accepted, rejected): sums over this partition's URLs (url, side, n), handed on as they fill the memory."""
    total: tuple[Counter[bytes], Counter[bytes]] = Counter(), Counter()

    def rows() -> pa.RecordBatch:
        keys = list({*total[0], *total[1]})
        columns = [pa.array(keys, pa.binary()), *(pa.array([t[k] for k in keys], pa.int64()) for t in total)]
        for t in total:
            t.clear()
        return pa.RecordBatch.from_arrays(columns, names=["gram", "accepted", "rejected"])

    for b in batches:
        for url, side, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            for gram in grams(url):
                total[side][gram] += n
            if len(total[0]) + len(total[1]) > COUNTED:
                yield rows()
    yield rows()


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, gram): the distinct grams of URLs (part, url) that stand together."""
    for b in batches:
        of: dict[int, set[bytes]] = {}
        for part, url in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            of.setdefault(part, set()).update(grams(url))
        parts = np.repeat(np.array(list(of), dtype=np.int64), [len(x) for x in of.values()])
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array([g for x in of.values() for g in x], pa.binary())], names=["part", "gram"])


def ratio(url: str, counts: dict[bytes, tuple[int, int]]) -> float:
    """Log-likelihood difference a character, accepted less rejected, under two models that blend each context with
    the one shorter by a byte: as much weight to the longer as it has been seen, STRENGTH to the shorter."""
    total, none, every = 0.0, (0, 0), contexts(url)
    for before, byte in every:
        p = q = 1 / 256
        for context in before:
            seen = counts.get(b"\x00" + context, none)
            if seen == none:  # nor is any longer one
                break
            both = counts.get(b"\x01" + context + byte, none)
            p, q = (both[0] + STRENGTH * p) / (seen[0] + STRENGTH), (both[1] + STRENGTH * q) / (seen[1] + STRENGTH)
        total += math.log(p / q)
    return total / len(every)


def _score(urls: pa.Table, model: pa.Table) -> pa.Table:
    counts = dict(zip(model.column("gram").to_pylist(), zip(model.column("accepted").to_pylist(), model.column("rejected").to_pylist())))
    return pa.table({"s_url": urls.column("url"), "score": pa.array([ratio(u, counts) for u in urls.column("url").to_pylist()], pa.float64())})


def distinct_urls(urls: DataFrame, a_part: int = A_PART) -> DataFrame:
    """(url, side, n, part): each url (url, side: 0 accepted, 1 rejected, null neither) once, with how often it comes,
    dealt to parts of about `a_part`."""
    own = stored(urls.groupBy("url").agg(F.first("side").alias("side"), F.count("*").alias("n")), "urls")
    parts = 1 + own.count() // a_part
    return own.withColumn("part", F.pmod(F.xxhash64("url"), F.lit(parts)))


def counted(urls: DataFrame) -> DataFrame:
    """The model: (gram, accepted, rejected) over all of these URLs."""
    known = spread(urls.where("side is not null").select("url", F.col("side").cast("int").alias("side"), "n"))
    sums = in_batches(known, _count, "gram binary, accepted long, rejected long").groupBy("gram")
    return sums.agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))


def scores(urls: DataFrame, model: DataFrame) -> DataFrame:
    """(s_url, score) of each distinct url, from the counts that its part needs."""
    tasks = int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = in_batches(urls.select("part", "url").repartition(tasks, "part"), _wanted, "part long, gram binary").distinct()
    own = wanted.join(model, "gram").select("part", "gram", "accepted", "rejected")
    return urls.select("part", "url").groupBy("part").cogroup(own.groupBy("part")).applyInArrow(_score, "s_url string, score double")


def threshold(scored: DataFrame) -> float:
    """From (side, n, score) of URLs that the model has not seen: the score with the least sum of both sides' error
    rates, nearest 0 among equals; 0 where a side has none. The driver gets at most 2 * BINS counts."""
    place = F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor(F.col("score") / STEP) + BINS // 2)).cast("int")
    hist = np.zeros((2, BINS))
    for r in scored.groupBy("side", place.alias("bin")).agg(F.sum("n").alias("n")).collect():
        hist[int(r.side), r.bin] = r.n
    if not hist[0].sum() or not hist[1].sum():
        return 0.0
    share = np.concatenate([np.zeros((2, 1)), np.cumsum(hist, axis=1)], axis=1) / hist.sum(axis=1)[:, None]
    wrong = share[0] + 1 - share[1]  # accepted ones below, rejected ones from there on
    best = np.nonzero(wrong <= wrong.min() + 1e-12)[0]
    return float((best[np.abs(best - BINS // 2).argmin()] - BINS // 2) * STEP)


def held_out() -> Column:
    """The fifth of the URLs that sets the threshold and is not counted."""
    return F.pmod(F.xxhash64(F.lit(5), "url"), F.lit(5)) == 0


def judged(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score of each page. The URLs that rules decide are what the models
    learn from, but for a fifth that sets the threshold; the models decide the others.

    A null url is empty: no host, path or rule, and the score of an empty text. Where rules allow none or block none,
    all others are allowed. A null page_id stays; repeated rows are judged each; other columns are ignored; no rows
    give no rows."""
    d = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"))
    host, path = host_and_path(F.col("url"))
    d = d.withColumn("host", host).withColumn("path", path)
    rule, says = rule_for(F.col("host"), F.col("path"), rules)
    d = d.withColumn("rule", rule).withColumn("says", says)
    urls = distinct_urls(d.select("url", F.when(F.col("says").isNotNull(), (F.col("says") == "block").cast("int")).alias("side")))
    model = stored(counted(urls.where(~held_out())), "model")
    found = stored(scores(urls, model), "scores")
    sides = model.agg(F.sum("accepted"), F.sum("rejected")).first()
    cut = threshold(urls.where(held_out() & F.col("side").isNotNull()).join(found, F.col("url") == F.col("s_url")).select("side", "n", "score"))
    allowed = F.col("score") >= cut if all(sides) else F.lit(True)
    out = d.join(found, F.col("url") == F.col("s_url"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("says", F.when(allowed, "allow").otherwise("block")).alias("verdict"), "score")
