"""The trie of shared beginnings of conversations, from the longest common prefixes of sorted neighbours."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexispark.llm.common import drop_stored, stored

#: Turns that are put side by side in one row to be sorted; longer conversations are sorted by names of such rows.
SYMBOLS = 64
#: Turns of one bucket of running sums, depths that one row is unfolded to at a time, and (2**12) ids of a chunk.
TURNS, DEPTHS, IDS = 1024, 4096, 12
#: Conversations of a block of the array, at least; a block has about the square root of all of them if that is more.
BLOCK = 4096
_NONE = np.iinfo(np.int64).max
_EMPTY = hashlib.sha256(b"").hexdigest()
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def ordered_turns(turns: DataFrame, speaker: str = "role") -> DataFrame:
    """conv_id, place (from 1), digest (of speaker and text) and size (code points of the text) of each turn.

    Turns go by `turn`, null first; of one turn the first 64 characters of the speaker, then of the text, then the digest
    decide; equal rows are turns of their own. A null speaker or text is empty; rows without a conv_id are left out.

    Rows are dealt out by ranges of that order, so a conversation, or a turn, of any number of rows is cut into parts;
    a place is the row's number in its part after what the conversation has in earlier parts."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (speaker, "text"))
    slim = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.substring(role, 1, 64).alias("by"), F.substring(text, 1, 64).alias("start"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("digest"), F.length(text).cast("long").alias("size"), F.monotonically_increasing_id().alias("row"),
    ).where("conv_id is not null")
    order = ["turn", "by", "start", "digest", "row"]
    dealt = stored(slim.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()), "turns")
    own = dealt.withColumn("place", F.row_number().over(W.partitionBy("conv_id", "part").orderBy(*order)).cast("long"))
    return _after(own, dealt, "conv_id", "part", {"place": F.count("*")}).select("conv_id", "place", "digest", "size")


def _after(rows: DataFrame, source: DataFrame, key: str, part: str, sums: dict[str, Column]) -> DataFrame:
    """rows with the columns of `sums` raised by what that aggregate of `source` comes to in earlier parts of the key."""
    earlier = W.partitionBy("k_").orderBy("p_").rowsBetween(W.unboundedPreceding, -1)
    parts = source.groupBy(F.col(key).alias("k_"), F.col(part).alias("p_")).agg(*(c.alias(f"{n}_") for n, c in sums.items()))
    before = parts.select("k_", "p_", F.row_number().over(W.partitionBy("k_").orderBy("p_")).alias("n_"), *(F.sum(f"{n}_").over(earlier).alias(f"{n}_") for n in sums)).where("n_ > 1")
    found = rows.join(before, (F.col(key) == F.col("k_")) & (F.col(part) == F.col("p_")), "left")
    return found.withColumns({n: F.col(n) + F.coalesce(f"{n}_", F.lit(0)) for n in sums}).select(*rows.columns)


def _ranked(rows: DataFrame, *order: str) -> DataFrame:
    """rows with their rank, from 0: their place in their own range after the sizes of the ranges before it."""
    dealt = stored(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "sorted")
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select(F.col("part").alias("p_"), (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before_"))  # a row for each range
    own = dealt.withColumn("rank", F.row_number().over(W.partitionBy("part").orderBy(*order)) - 1)
    return own.join(before, F.col("part") == F.col("p_")).select(*rows.columns, (F.col("rank") + F.col("before_")).cast("long").alias("rank"))


def rebuilt(places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ordered turns: those of conversations that begin with the first h turns of conversation conv_id - conv_id % 100
    in place of their own first h; h = crc32(conv_id in decimals) % 6. And the conv_ids, of turnless ones too."""
    base, h = F.col("conv_id") - F.col("conv_id") % 100, F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    convs = places.select("conv_id").distinct()
    heads = places.where((F.col("conv_id") % 100 == 0) & (F.col("place") <= 5))
    heads = heads.select(F.col("conv_id").alias("b_"), F.col("place").alias("at_"), "digest", "size")
    taken = convs.withColumn("base", base).withColumn("h", h).join(heads, (F.col("base") == F.col("b_")) & (F.col("at_") <= F.col("h")))
    lengths = heads.groupBy("b_").agg(F.max("at_").alias("has_"))
    own = places.withColumn("base", base).withColumn("h", h).where(F.col("place") > F.col("h")).join(lengths, F.col("base") == F.col("b_"), "left")
    moved = F.col("place") - F.col("h") + F.least(F.col("h"), F.coalesce("has_", F.lit(0)))
    return taken.select("conv_id", F.col("at_").alias("place"), "digest", "size").unionByName(own.select("conv_id", moved.alias("place"), "digest", "size")), convs


def _prefixes(turns: DataFrame) -> DataFrame:
    """turns with two 64-bit marks of all turns up to each, sums of hashes of (place, digest), and the sizes' sum."""
    marks = [F.xxhash64(F.lit(seed), "place", "digest") for seed in (1, 2)]
    lanes = {f"{n}{k}": half for k, m in enumerate(marks) for n, half in (("a", F.shiftrightunsigned(m, 32)), ("b", m.bitwiseAND(F.lit(2**32 - 1))))}
    rows = turns.withColumns(lanes | {"upto": F.col("size"), "bucket": F.floor((F.col("place") - 1) / TURNS)})
    running = W.partitionBy("conv_id", "bucket").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    sums = [*lanes, "upto"]
    own = rows.withColumns({n: F.sum(n).over(running) for n in sums})
    own = _after(own, rows, "conv_id", "bucket", {n: F.sum(n) for n in sums})
    both = [F.shiftleft(f"a{k}", 32).bitwiseXOR(F.col(f"b{k}")).alias(f"mark{k}") for k in range(2)]
    return own.select("conv_id", "place", "digest", "size", "upto", *both)


def _keys(turns: DataFrame, symbols: int) -> DataFrame:
    """conv_id and an array of at most `symbols` binaries that sorts as the conversation's digests do. While any
    conversation has more, runs of that many are named by their rank among all such runs, which keeps the order."""
    level = turns.select("conv_id", (F.col("place") - 1).alias("at"), F.col("digest").alias("symbol"))
    side_by_side = F.transform(F.array_sort(F.collect_list(F.struct("at", "symbol"))), lambda x: x["symbol"]).alias("key")
    while (level.agg(F.max("at")).first()[0] or 0) >= symbols:
        runs = stored(level.groupBy("conv_id", F.floor(F.col("at") / symbols).alias("run")).agg(side_by_side), "runs")
        names = _ranked(runs.select("key").distinct(), "key").select(F.col("key").alias("key_"), F.unhex(F.lpad(F.hex("rank"), 16, "0")).alias("symbol"))
        level = stored(runs.join(names, F.col("key") == F.col("key_")).select("conv_id", F.col("run").alias("at"), "symbol"), "names")
        drop_stored(runs)
    return level.groupBy("conv_id").agg(side_by_side)


class Blocks:
    """What every task knows of all blocks of the array: the least LCP and conv_id of each, and sums before it."""

    def __init__(self, rows: list, size: int, total: int):
        rows = sorted(rows, key=lambda r: r["block"])
        self.size, self.total = size, total
        self.lcp, self.low, q, leaf = (np.array([r[k] for r in rows], dtype=np.int64) for k in ("lcp", "low", "q", "leaf"))
        self.q, self.leaf = (np.concatenate([[0], np.cumsum(x)]) for x in (q, leaf))

    def smaller(self, block: int, values: list[int], left: bool) -> list[int]:
        """For each value the nearest block to the left or right that holds a smaller LCP; -1 if none does."""
        beyond = self.lcp[:block][::-1] if left else self.lcp[block + 1 :]
        least = np.minimum.accumulate(beyond)  # falls, so the first below a value is found by bisection
        at = np.searchsorted(-least, -np.array(values, dtype=np.int64), side="right")
        return [-1 if a == len(least) else (block - 1 - a if left else block + 1 + a) for a in at.tolist()]


def _open(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a block: whether no smaller value stands to the left, to the right of each."""
    left = np.concatenate([[_NONE], np.minimum.accumulate(lcp)[:-1]]) >= lcp
    right = np.concatenate([np.minimum.accumulate(lcp[::-1])[::-1][1:], [_NONE]]) >= lcp
    return left, right


def _column(rows: np.ndarray, name: str) -> np.ndarray:
    return np.fromiter((r[name] for r in rows), np.int64, len(rows))


def _ask(blocks: Blocks):
    """The values whose nearest smaller one lies beyond their block, and the block that holds it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for block, rows in zip(b["block"].tolist(), b["rows"]):
                lcp = _column(rows, "lcp")
                for side, is_open in zip((0, 1), _open(lcp)):
                    values = np.unique(lcp[is_open])
                    values = values[values >= 0].tolist()
                    yield pd.DataFrame({"block": block, "side": side, "v": values, "target": blocks.smaller(block, values, side == 0)}, dtype=np.int64)

    return run


def _answer(blocks: Blocks):
    """For each asked value: the place of the nearest smaller one in this block, its LCP, the least conv_id from there
    to the edge, and sums up to there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for block, rows, asked in zip(b["block"].tolist(), b["rows"], b["asked"]):
                lcp, conv, q, leaf = (_column(rows, k) for k in ("lcp", "conv_id", "q", "leaf"))
                side, v = _column(asked, "side"), _column(asked, "v")
                at = np.empty(len(v), dtype=np.int64)
                from_right, from_left = np.minimum.accumulate(lcp[::-1]), np.minimum.accumulate(lcp)
                at[side == 0] = len(lcp) - 1 - np.searchsorted(-from_right, -v[side == 0], side="right")
                at[side == 1] = np.searchsorted(-from_left, -v[side == 1], side="right")
                behind, ahead = np.minimum.accumulate(conv[::-1])[::-1], np.concatenate([[_NONE], np.minimum.accumulate(conv)])
                cq, cl = (np.concatenate([[0], np.cumsum(x)]) + base[block] for x, base in ((q, blocks.q), (leaf, blocks.leaf)))
                left = side == 0
                yield pd.DataFrame({"target": block, "side": side, "v": v, "place": block * blocks.size + at, "lcp": lcp[at], "low": np.where(left, behind[at], ahead[at]), "q": np.where(left, cq[at + 1], cq[at]), "leaf": cl[at]})

    return run


def _scan(lcp: list[int], conv: list[int], backwards: bool) -> tuple[list[int], list[int]]:
    """By a stack: of each place the nearest strictly smaller one before it (-1: none here) and the least conv_id of the
    interval's conversations on that side; backwards: after it, the place's own conversation among them."""
    n = len(lcp)
    near, low, stack = [-1] * n, [_NONE] * n, []
    for p in range(n - 1, -1, -1) if backwards else range(n):
        least = conv[p] if backwards else (conv[p - 1] if p else _NONE)
        v = lcp[p]
        while stack and lcp[stack[-1]] >= v:
            x = low[stack.pop()]
            if x < least:
                least = x
        near[p], low[p] = (stack[-1] if stack else -1), least
        stack.append(p)
    return near, low


def _build(blocks: Blocks):
    """Rows of three kinds: 0, each place of the array with the interval that its LCP spans; 1, each conversation that
    goes on alone, with the LCP from which on it does; 2, each other conversation with the interval that it ends in."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for block, rows, answers in zip(b["block"].tolist(), b["rows"], b["answers"]):
                first = block * blocks.size
                lcp, after, conv, length, q, leaf = (_column(rows, k) for k in ("lcp", "after", "conv_id", "len", "q", "leaf"))
                rank = first + np.arange(len(lcp))
                cq, cl = (np.concatenate([[0], np.cumsum(x)]) + base[block] for x, base in ((q, blocks.q), (leaf, blocks.leaf)))
                known = {0: {}, 1: {}}
                for a in answers if answers is not None else ():
                    between = blocks.low[a["target"] + 1 : block] if a["side"] == 0 else blocks.low[block + 1 : a["target"]]
                    known[a["side"]][a["v"]] = (a["place"], a["lcp"], min(int(between.min()) if len(between) else _NONE, a["low"]), a["q"], a["leaf"])
                # nothing smaller to the right of a value: its interval ends with the array
                end = (blocks.total, -1, int(blocks.low[block + 1 :].min()) if block + 1 < len(blocks.low) else _NONE, int(blocks.q[-1]), int(blocks.leaf[-1]))
                sides = []
                for side, is_open in zip((0, 1), _open(lcp)):
                    near, low = (np.array(x, dtype=np.int64) for x in _scan(lcp.tolist(), conv.tolist(), side == 1))
                    at = np.maximum(near, 0)
                    # up to and with the left end; up to the right end
                    found = [rank[at], lcp[at], low, cq[at + 1] if side == 0 else cq[at], cl[at]]
                    for p in np.flatnonzero(is_open & (lcp >= 0)).tolist():
                        far = known[side].get(int(lcp[p]), end)
                        for column, x in zip(found, far):
                            column[p] = min(column[p], x) if column is low else x
                    sides.append(found)
                (lo, lo_lcp, lo_low, lo_q, lo_leaf), (hi, hi_lcp, hi_low, hi_q, hi_leaf) = sides
                u = np.maximum(lo_lcp, hi_lcp)
                places = pd.DataFrame({"kind": 0, "p": rank, "lo": lo, "v": lcp, "u": u, "up": np.where(u < 0, -1, np.where(lo_lcp >= hi_lcp, lo, hi)), "conv_id": np.minimum(lo_low, hi_low), "n_convs": hi - lo, "n_leaves": hi_leaf - lo_leaf, "q": hi_q - lo_q})
                shared = np.maximum(lcp, after)
                alone = pd.DataFrame({"kind": 1, "p": rank, "lo": -1, "v": length, "u": shared, "up": np.where(shared < 0, -1, np.where(lcp >= after, rank, rank + 1)), "conv_id": conv, "n_convs": 1, "n_leaves": 1, "q": 0})
                ends = alone.assign(kind=2, lo=np.where(lcp == length, lo, rank))
                yield pd.concat([places[lcp >= 0], alone[length > shared], ends[length <= shared]])

    return run


def _ends(found: DataFrame) -> DataFrame:
    """lo, v and the hash of the conv_ids that end in that interval, in order. Ids are joined in chunks of neighbours,
    bounded as ids are distinct; hashes of many chunks are carried on from one to the next in one pass over them."""
    chunk = F.shiftright("conv_id", IDS).alias("chunk")
    chunks = found.where("kind = 2").groupBy("lo", "v", chunk).agg(F.array_join(F.array_sort(F.collect_set("conv_id")).cast("array<string>"), ",").alias("ids"))
    chunks = stored(chunks, "ends")
    each = chunks.groupBy("lo", "v").agg(F.count("*").alias("n"), F.min("ids").alias("ids"))
    one = each.where("n = 1").select("lo", "v", F.sha2("ids", 256).alias("ends"))
    large = each.where("n > 1").select(F.col("lo").alias("lo_"), F.col("v").alias("v_"))
    many = chunks.join(large, (F.col("lo") == F.col("lo_")) & (F.col("v") == F.col("v_"))).select(*chunks.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h = None, None
        row = lambda: pa.RecordBatch.from_pydict({"lo": [now[0]], "v": [now[1]], "ends": [h.hexdigest()]}, schema=pa.schema([("lo", pa.int64()), ("v", pa.int64()), ("ends", pa.string())]))
        for b in batches:
            for lo, v, ids in zip(*(b.column(n).to_pylist() for n in ("lo", "v", "ids"))):
                if now == (lo, v):
                    h.update(b",")
                else:
                    if now is not None:
                        yield row()
                    now, h = (lo, v), hashlib.sha256()
                h.update(ids.encode())
        if now is not None:
            yield row()

    return one.unionByName(many.repartition("lo", "v").sortWithinPartitions("lo", "v", "chunk").mapInArrow(run, "lo long, v long, ends string"))


def prefix_trie(turns: DataFrame, convs: DataFrame, block: int = BLOCK, symbols: int = SYMBOLS) -> DataFrame:
    """The trie of sequences of turns: a row for each distinct beginning of d turns, d = 0 (all of `convs`) among them.

    turns: conv_id, place (1, 2, ... without gaps), digest, size; convs: the distinct conv_ids, turnless ones too.
    Returns conv_id (the least of those that begin so), depth, parent_conv_id, n_convs, n_children, n_leaves (nodes without
    children at or below it), saved_tokens (the sum, at or below it, of (n_convs - 1) * size of the last turn) and
    ends_sha256 (of the conv_ids that end there, ascending, with commas).

    Conversations are sorted by range. A prefix is known by 128 bits, so a neighbour's LCP is the number of places where
    both have the same. Nodes where conversations part or end are the intervals of the Cartesian tree over the LCP array:
    each place's nearest smaller values, found by a stack within blocks and beyond them by the blocks' minima; places of
    equal LCP in an interval are one node. A block has some square root of all conversations, so what all tasks are sent,
    four numbers a block, stays small. Depths between a node and its parent are unfolded by a join with the turns of its
    first conversation. Sums over an interval are differences of sums along the array."""
    spark = turns.sparkSession
    prefixes = stored(_prefixes(turns), "prefixes")
    lengths = prefixes.groupBy("conv_id").agg(F.max("place").alias("len")).withColumnRenamed("conv_id", "c_")
    keys = _keys(prefixes, symbols).select(F.col("conv_id").alias("k_"), "key")
    whole = convs.join(lengths, F.col("conv_id") == F.col("c_"), "left").join(keys, F.col("conv_id") == F.col("k_"), "left")
    whole = whole.select("conv_id", F.coalesce("len", F.lit(0)).cast("long").alias("len"), F.coalesce("key", F.array().cast("array<binary>")).alias("key"))
    ranks = stored(_ranked(whole, "key", "conv_id").drop("key"), "ranks")
    total = ranks.count()
    if not total:
        return spark.createDataFrame([], _NODE)
    lined = stored(prefixes.join(ranks.select(F.col("conv_id").alias("c_"), "rank"), F.col("conv_id") == F.col("c_")).select("rank", "place", "mark0", "mark1", "size"), "lined")
    same = ["rank", "place", "mark0", "mark1"]
    shared = lined.join(lined.withColumn("rank", F.col("rank") + 1).drop("size"), same).groupBy("rank").agg(F.count("*").alias("n"), F.sum("size").alias("q"))
    sides = shared.select(F.explode(F.array(F.struct("rank", F.col("n").alias("lcp"), "q", F.lit(None).cast("long").alias("after")), F.struct((F.col("rank") - 1).alias("rank"), F.lit(None).cast("long").alias("lcp"), F.lit(None).cast("long").alias("q"), F.col("n").alias("after")))).alias("x"))
    sides = sides.select("x.*").groupBy("rank").agg(F.max("lcp").alias("lcp"), F.max("q").alias("q"), F.max("after").alias("after"))
    zero = F.lit(0).cast("long")
    line = ranks.join(sides, "rank", "left").select(
        "rank", "conv_id", "len", F.when(F.col("rank") == 0, -1).otherwise(F.coalesce("lcp", zero)).cast("long").alias("lcp"), F.coalesce("q", zero).alias("q"),
        F.when(F.col("rank") == total - 1, -1).otherwise(F.coalesce("after", zero)).cast("long").alias("after"),
    )
    size = max(block, math.isqrt(total))
    line = line.withColumns({"leaf": (F.col("len") > F.col("after")).cast("long"), "block": F.floor(F.col("rank") / size)})
    array = stored(line.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("rank", "conv_id", "len", "lcp", "q", "after", "leaf"))).alias("rows"), F.min("lcp").alias("lcp"), F.min("conv_id").alias("low"), F.sum("q").alias("q"), F.sum("leaf").alias("leaf")), "array")
    sent = spark.sparkContext.broadcast(Blocks(array.drop("rows").collect(), size, total))
    array = array.select("block", "rows")
    asked = stored(array.mapInPandas(lambda b: _ask(sent.value)(b), "block long, side long, v long, target long").where("target >= 0"), "asked")
    by_target = asked.select(F.col("target").alias("t_"), "side", "v").distinct().groupBy("t_").agg(F.collect_list(F.struct("side", "v")).alias("asked"))
    answers = array.join(by_target, F.col("block") == F.col("t_")).select("block", "rows", "asked").mapInPandas(lambda b: _answer(sent.value)(b), "target long, side long, v long, place long, lcp long, low long, q long, leaf long")
    by_block = asked.join(answers, ["target", "side", "v"]).groupBy(F.col("block").alias("b_")).agg(F.collect_list(F.struct("side", "v", "target", "place", "lcp", "low", "q", "leaf")).alias("answers"))
    found = array.join(by_block, F.col("block") == F.col("b_"), "left").select("block", "rows", "answers")
    found = stored(found.mapInPandas(lambda b: _build(sent.value)(b), "kind long, p long, lo long, v long, u long, up long, conv_id long, n_convs long, n_leaves long, q long"), "found")
    places = found.where("kind = 0")
    merged = places.groupBy("lo", "v").agg(*(F.max(c).alias(c) for c in ("u", "up", "n_convs", "n_leaves", "q")), F.min("conv_id").alias("conv_id"))
    nodes = merged.unionByName(found.where("kind = 1").select(*merged.columns))
    above = places.select(F.col("p").alias("p_"), F.col("conv_id").alias("parent"), F.col("lo").alias("plo"), F.col("v").alias("pv"))
    nodes = stored(nodes.join(above, F.col("up") == F.col("p_"), "left").drop("p_", "up"), "nodes")
    children = nodes.where("plo is not null").groupBy(F.col("plo").alias("lo"), F.col("pv").alias("v")).agg(F.count("*").alias("children"))
    nodes = nodes.drop("plo", "pv").join(children, ["lo", "v"], "left").join(_ends(found), ["lo", "v"], "left")
    alone = F.col("lo") < 0
    ends = F.when(alone, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.coalesce("ends", F.lit(_EMPTY)))
    spans = nodes.withColumn("ends", ends).withColumn("from_", F.explode(F.sequence(F.col("u") + 1, F.col("v"), F.lit(DEPTHS).cast("long")))).repartition("conv_id", "from_")
    spans = spans.withColumn("depth", F.explode(F.sequence(F.col("from_"), F.least(F.col("from_") + DEPTHS - 1, "v"))))
    before = prefixes.select(F.col("conv_id").alias("c_"), F.col("place").alias("d_"), (F.col("upto") - F.col("size")).alias("before"))
    full = spans.join(before, (F.col("conv_id") == F.col("c_")) & (F.col("depth") == F.col("d_")), "left")
    last = F.col("depth") == F.col("v")
    return full.select(
        "conv_id", "depth", F.when(F.col("depth") > F.col("u") + 1, F.col("conv_id")).otherwise(F.col("parent")).alias("parent_conv_id"), "n_convs",
        F.when(last, F.coalesce("children", zero)).otherwise(1).cast("long").alias("n_children"), "n_leaves",
        (F.col("q") - (F.col("n_convs") - 1) * F.coalesce("before", zero)).cast("long").alias("saved_tokens"), F.when(last, F.col("ends")).otherwise(F.lit(_EMPTY)).alias("ends_sha256"),
    )


def rebuilt_trie(turns: DataFrame, **options) -> DataFrame:
    """prefix_trie() of the rebuilt conversations. Null conv_ids are left out, nulls elsewhere and ties as in
    ordered_turns(); other columns are ignored; no conversations give no rows."""
    return prefix_trie(*rebuilt(stored(ordered_turns(turns), "places")), **options)


#: The rows of rebuilt_trie() over `conversations`; ties beyond the first 64 characters aside.
SQL = f"""
WITH t AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, substring(coalesce(role, ''), 1, 64), substring(coalesce(text, ''), 1, 64)) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base,
    xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda a, x: list_reduce(list_concat([xor(a, x)], CAST(range(8) AS BIGINT[])), lambda s, i: xor(s >> 1, (s & 1) * 3988292384)))) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
k AS (SELECT c.*, least(h, (SELECT count(*) FROM t WHERE t.conv_id = c.base)) AS had FROM c),
r AS (SELECT k.conv_id, t.place, role, text FROM k JOIN t ON t.conv_id = k.base WHERE t.place <= k.h
  UNION ALL SELECT k.conv_id, t.place - k.h + k.had, role, text FROM k JOIN t USING (conv_id) WHERE t.place > k.h),
p AS (SELECT conv_id, place AS depth, length(text) AS size, md5(string_agg(md5(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING)) AS prefix FROM r
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
e AS (SELECT conv_id, max(depth) AS depth FROM p GROUP BY 1),
n AS (SELECT p.depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, min(size) AS size,
    coalesce(sha256(string_agg(CAST(CASE WHEN e.depth = p.depth THEN conv_id END AS VARCHAR), ',' ORDER BY conv_id)), '{_EMPTY}') AS ends_sha256
  FROM p JOIN e USING (conv_id) GROUP BY p.depth, p.prefix),
up AS (SELECT n.depth, n.prefix, p.prefix AS above FROM n JOIN p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1),
ch AS (SELECT depth - 1 AS depth, above AS prefix, count(*) AS n_children FROM up GROUP BY ALL),
s AS (SELECT p.depth, p.prefix, sum((n.n_convs - 1) * n.size) AS saved, count(*) FILTER (WHERE ch.n_children IS NULL) AS leaves
  FROM n LEFT JOIN ch USING (depth, prefix) JOIN p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY ALL)
SELECT n.conv_id, n.depth, a.conv_id AS parent_conv_id, n.n_convs, coalesce(ch.n_children, 0) AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves,
  CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN s USING (depth, prefix) LEFT JOIN ch USING (depth, prefix) LEFT JOIN up USING (depth, prefix) LEFT JOIN n a ON a.depth = n.depth - 1 AND a.prefix = up.above
"""
