"""Near-duplicate documents: bottom-k sketches of one hash, inverted lists, union sketches, exact confirmation."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import components, drop_stored, in_batches, spread, stored, text_of

#: Values that a sketch retains.
KEPT = 64
#: Members of longer lists are crowded: they are dealt with by their whole sets.
LONG = 16
#: Words of 64 bits of the signature by which members of long lists are compared.
SIGN_WORDS = 8
#: Words whose hashes a Python worker keeps; beyond that it starts anew.
_WORDS = 100_000
_STEPS = np.array([pow(0x9E3779B97F4A7C15, 2 * i + 1, 2**64) for i in range(5)], dtype=np.uint64)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


_hashes = _Hashes()


def shingles(text: str, words: int = 5) -> np.ndarray:
    """The sorted set of 64-bit hashes of a text's shingles; a text of fewer words has one, of all its words."""
    if len(_hashes) > _WORDS:
        _hashes.clear()
    found = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(found)
    h = np.fromiter(map(_hashes.__getitem__, found), dtype=np.uint64, count=n)
    if not n:
        return h
    with np.errstate(over="ignore"):
        if n < words:
            return np.array([xxhash.xxh64_intdigest(h.tobytes(), seed=n)], dtype=np.uint64)
        out = h[: n - words + 1] * _STEPS[0]
        for i in range(1, words):
            out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + h[i : n - words + 1 + i] * _STEPS[i]
        out = (out ^ (out >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
        return np.unique(out ^ (out >> np.uint64(31)))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, mark, kept, ends = [], [], [], [0]
        for text in b.column(2):
            found = shingles(text.as_py())
            n.append(len(found))
            mark.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
            kept.append(found[:KEPT].view(np.int64))
            ends.append(ends[-1] + len(kept[-1]))
        values = pa.array(np.concatenate(kept) if kept else np.zeros(0, np.int64), pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(mark, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], names=["doc_id", "tkey", "n", "mark", "sketch"])


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, tkey (hash of the text), n (shingles), mark (digest of the set; null if it is empty), sketch."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("tkey"), text_of().alias("text"))
    return in_batches(spread(d), _sketch, "doc_id long, tkey long, n long, mark binary, sketch array<long>")


def shared(percent: int) -> int:
    """The fewest values of KEPT that texts of that similarity share: less than 1e-11 of such pairs share fewer
    (binomial tail; the true law is narrower)."""
    tail, p = 0.0, percent / 100
    for k in range(KEPT):
        tail += math.comb(KEPT, k) * p**k * (1 - p) ** (KEPT - k)
        if tail >= 1e-11:
            return k
    return KEPT


def first_values(percent: int) -> int:
    """How many of a sketch's smallest values: one of these such texts share but for 1e-13 of them."""
    return next((k for k in range(1, KEPT) if (1 - percent / 100) ** k < 1e-13), KEPT)


def _least_shared(n: Column, percent: int) -> Column:
    """Values of a sketch that any near text's sketch shares with it: all but the dissimilar part of a set so small
    that its partners' sketches are whole too, else shared()."""
    whole = F.ceil(n * percent / 100)
    return F.when(n <= KEPT * percent // 100, whole).otherwise(F.least(whole, F.lit(shared(percent)))).cast("int")


def _fits(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _estimated(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose union sketch allows the similarity, with the estimate."""
    side = lambda x: marks.select(F.col("mark").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    full = pairs.join(side("a"), "a").join(side("b"), "b")
    cut = (F.col("n_a") > KEPT) | (F.col("n_b") > KEPT)
    # order of unsigned values, as they were chosen
    turned = lambda c: F.transform(c, lambda x: x.bitwiseXOR(F.lit(-(2**63))))
    union = F.array_sort(F.array_union(turned("s_a"), turned("s_b")))
    union = F.when(cut, F.slice(union, 1, KEPT)).otherwise(union)
    both = F.array_intersect(turned("s_a"), turned("s_b"))
    full = full.withColumn("in_union", F.size(union)).withColumn("in_both", F.size(F.array_intersect(union, both)))
    near = F.when(cut, F.col("in_both") >= shared(percent)).otherwise(100 * F.col("in_both") >= percent * F.col("in_union"))
    return full.where(near & _fits(F.col("n_a"), F.col("n_b"), percent)).select("a", "b", (F.col("in_both") / F.col("in_union")).alias("estimate"))


def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep, last, known = [], None, None
        for one, two in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
            if one != last:
                last, known = one, shingles(one)
            other = shingles(two)
            both = len(np.intersect1d(known, other, assume_unique=True))
            keep.append(100 * both >= percent * (len(known) + len(other) - both))
        yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are that similar."""
    side = lambda x: texts.select(F.col("mark").alias(x), F.col("text").alias(f"t_{x}"))
    full = pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a").select("a", "b", "t_a", "t_b")
    return in_batches(full, partial(_confirm, percent=percent), "a binary, b binary")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingles(t.as_py()) for t in b.column(1)]
        ends = np.cumsum([0, *map(len, sets)])
        values = pa.array(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64), pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(ends), pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], names=["mark", "n", "found"])


def _listed(values: DataFrame, size: Column, need: Column) -> DataFrame:
    """Lists (value, mark, n, pos) of marks by their values that stand first in order of frequency: all but need - 1
    of `size`. Two marks that share `need` values share one of these. Values of one mark alone come first in that
    order and need no list; pos counts them."""
    often = values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    per = values.join(often, "value").groupBy("mark", "n").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("seen"))
    alone = size - F.size("seen")
    per = per.where(F.size("seen") >= need).withColumn("alone", alone).select("mark", "n", "alone", F.posexplode(F.slice("seen", F.lit(1), F.greatest(F.lit(0), F.size("seen") - need + 1))).alias("pos", "s"))
    return per.select("s.value", "mark", "n", "alone", (F.col("alone") + F.col("pos")).alias("pos"))


def _room(a: str, b: str, percent: int) -> Column:
    """Whether two sets whose first common value stands at these places can still be similar enough."""
    rest = F.least(F.col(f"{a}.n") - F.col(f"{a}.pos"), F.col(f"{b}.n") - F.col(f"{b}.pos"))
    return (100 + percent) * rest >= percent * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def _all_pairs(lists: DataFrame, percent: int, ranked: bool) -> DataFrame:
    x, y = lists.alias("x"), lists.alias("y")
    on = (F.col("x.value") == F.col("y.value")) & (F.col("x.mark") < F.col("y.mark")) & _fits(F.col("x.n"), F.col("y.n"), percent)
    on = on & _room("x", "y", percent) if ranked else on
    return x.join(y, on).select(F.col("x.mark").alias("a"), F.col("y.mark").alias("b"))


def _signed(lists: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """lists with the sketch of each mark as SIGN_WORDS * 64 bits, and how many of them a near mark's bits share with
    it at least: those of the values shared at least, less one for each two values that fall on one bit."""
    bits = SIGN_WORDS * 64
    words = []
    for i in range(SIGN_WORDS):
        own = F.filter("sketch", lambda v, i=i: F.pmod(v, F.lit(bits)).between(64 * i, 64 * i + 63))
        words.append(F.aggregate(own, F.lit(0).cast("long"), lambda acc, v: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(v, F.lit(64)).cast("int")))).alias(f"w{i}"))
    signs = marks.select(F.col("mark").alias("g_mark"), _least_shared(F.col("n"), percent).alias("need"), F.size("sketch").alias("size"), *words)
    set_bits = sum((F.bit_count(f"w{i}") for i in range(1, SIGN_WORDS)), F.bit_count("w0"))
    signs = signs.withColumn("bar", F.col("need") - (F.col("size") - set_bits)).drop("need", "size")
    return lists.join(signs, F.col("mark") == F.col("g_mark")).drop("g_mark")


def _bits_allow(x: str, y: str) -> Column:
    both = [F.bit_count(F.col(f"{x}.w{i}").bitwiseAND(F.col(f"{y}.w{i}"))) for i in range(SIGN_WORDS)]
    return sum(both[1:], both[0]) >= F.greatest(f"{x}.bar", f"{y}.bar")


def _lead_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Each member of a list with the lead of its size class and of those beside it: the member with the fewest values
    of its own, which is the likest to the others. Size classes are as wide as the similarity allows, so that all
    partners of a member are in these."""
    own = lists.withColumn("class", F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(100 / percent)))))
    leads = own.groupBy("value", "class").agg(F.min(F.struct("alone", "n", "mark")).alias("l")).select("value", "class", F.col("l.mark").alias("lead"), F.col("l.n").alias("l_n"))
    near = own.withColumn("class", F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1))).join(leads, ["value", "class"])
    near = near.where((F.col("mark") != F.col("lead")) & _fits(F.col("n"), F.col("l_n"), percent))
    return near.select(F.least("mark", "lead").alias("a"), F.greatest("mark", "lead").alias("b"))


def linked(docs: DataFrame, rows: DataFrame, percent: int = 80) -> DataFrame:
    """Links (a, b) between marks of `rows`, from sketches(docs), that connect every two marks whose sets are
    percent % similar, directly or by way of others; each is confirmed on the whole sets.

    Lists hold the marks that retain a value. Of its sketch a mark enters only its rarest values: two sketches that
    share shared() values share one of their KEPT - shared() + 1 rarest, so lists of frequent passages are seldom used,
    and values that no other mark retains need no list. Lists up to LONG give all pairs of fitting sizes.

    Members of longer ones go by their whole sets instead: there, similar marks share one of the rarest (100 - percent)
    % of their values, without slack. Where a list is still long, its members are much alike: each is paired with the
    likest of its size class, then, if that leaves the list unconnected, those of different components with each other
    as far as their signatures allow, so that unlike texts that share a frequent passage make no pairs."""
    has = rows.where(F.col("mark").isNotNull())
    first = has.select("mark", F.explode(F.slice("sketch", 1, first_values(percent))).alias("value"))
    shared = first.groupBy("value").agg(F.min("mark").alias("low"), F.max("mark").alias("high")).where("low <> high").select("value")
    alive = first.join(shared, "value", "left_semi").select("mark").distinct()
    marks = has.join(alive, "mark", "left_semi").groupBy("mark").agg(F.min(F.struct("doc_id", "tkey", "n", "sketch")).alias("r"))
    marks = stored(marks.select("mark", "r.doc_id", "r.tkey", "r.n", "r.sketch"), "marks")
    size = F.least(F.col("n"), F.lit(KEPT)).cast("int")
    lists = stored(_listed(marks.select("mark", "n", F.explode("sketch").alias("value")), size, _least_shared(F.col("n"), percent)), "lists")
    lengths = lists.groupBy("value").agg(F.count("*").alias("m")).where("m > 1")
    sized = stored(lists.join(lengths, "value"), "lists")
    drop_stored(lists)
    texts = _texts(docs, marks, sized.select("mark").distinct())
    scratch = [marks, sized, texts]
    pairs = _all_pairs(sized.where(F.col("m") <= LONG), percent, False)
    long = None
    crowd = sized.where(F.col("m") > LONG).select("mark").distinct()
    if not crowd.isEmpty():
        sets = stored(in_batches(texts.join(crowd, "mark", "left_semi"), _sets, "mark binary, n long, found array<long>"), "sets")
        own = _listed(sets.select("mark", "n", F.explode("found").alias("value")), F.col("n").cast("int"), F.ceil(F.col("n") * percent / 100).cast("int"))
        own = stored(own, "lists")
        scratch += [sets, own]
        sizes = own.groupBy("value").agg(F.count("*").alias("m")).where("m > 1")
        own = stored(own.join(sizes, "value"), "lists")
        scratch.append(own)
        long = own.where(F.col("m") > LONG)
        pairs = pairs.unionByName(_all_pairs(own.where(F.col("m") <= LONG), percent, True)).unionByName(_lead_pairs(long, percent))
    pairs = stored(_estimated(pairs.distinct(), marks, percent), "pairs")
    # Links that are surely enough first: each mark with its likeliest partner. Others only across what these connect.
    best = pairs.select(F.col("a").alias("m"), "a", "b", "estimate").unionByName(pairs.select(F.col("b").alias("m"), "a", "b", "estimate"))
    best = best.groupBy("m").agg(F.max(F.struct("estimate", "a", "b")).alias("p")).select("p.a", "p.b").distinct()
    links = stored(_confirmed(best, texts, percent), "links")
    label = stored(components(links), "labels")
    scratch += [pairs, label]
    rest = _across(pairs.select("a", "b").join(best, ["a", "b"], "left_anti"), label)
    links = links.unionByName(stored(_confirmed(rest, texts, percent), "links"))
    if long is not None and not long.isEmpty():
        label = stored(components(links), "labels")
        named = stored(_labelled(long.select("value", "mark", "n", "pos"), "mark", label, "label"), "long")
        open_lists = named.groupBy("value").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("value")
        x = stored(_signed(named.join(open_lists, "value", "left_semi"), marks, percent), "long")
        scratch += [label, named, x]
        y = x.alias("y")
        x = x.alias("x")
        far = x.join(y, (F.col("x.value") == F.col("y.value")) & (F.col("x.label") < F.col("y.label")) & _fits(F.col("x.n"), F.col("y.n"), percent) & _room("x", "y", percent) & _bits_allow("x", "y"))
        far = far.select(F.least("x.mark", "y.mark").alias("a"), F.greatest("x.mark", "y.mark").alias("b")).distinct().join(pairs.select("a", "b"), ["a", "b"], "left_anti")
        links = links.unionByName(stored(_confirmed(_estimated(far, marks, percent), texts, percent), "links"))
    for table in scratch:
        drop_stored(table)
    return links


def _texts(docs: DataFrame, marks: DataFrame, wanted: DataFrame) -> DataFrame:
    """(mark, text) of one document for each mark that is wanted."""
    where = marks.join(wanted, "mark", "left_semi").select("mark", F.col("doc_id").alias("w_doc"), F.col("tkey").alias("w_key"))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("tkey"), text_of().alias("text"))
    d = d.join(where, F.col("doc_id").eqNullSafe(F.col("w_doc")) & (F.col("tkey") == F.col("w_key")))
    return stored(d.select("mark", "text").dropDuplicates(["mark"]), "texts")


def _labelled(df: DataFrame, of: str, label: DataFrame, name: str) -> DataFrame:
    l = label.select(F.col("node").alias(of), F.col("component").alias("l_c"))  # noqa: E741
    return df.join(l, of, "left").withColumn(name, F.coalesce("l_c", of)).drop("l_c")


def _across(pairs: DataFrame, label: DataFrame) -> DataFrame:
    return _labelled(_labelled(pairs, "a", label, "c_a"), "b", label, "c_b").where("c_a <> c_b").select("a", "b")


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, tkey.

    Equal sets are one class from the start. A null or blank text has an empty set and is linked with nothing; a null
    doc_id stays null and gives its component no id unless all its ids are null; of such a component the rows with the
    least tkey are kept, and otherwise those whose doc_id is the component's; repeated rows are each reported, in one
    component; other columns are ignored; no rows give no rows.

    Components are found between marks and so are their least ids; documents meet their mark's result by a plain
    equi-join, which adaptive execution splits where one text has very many copies."""
    rows = stored(sketches(docs), "sketches")
    links = linked(docs, rows, percent)
    label = stored(components(links), "labels")
    slim = rows.select("doc_id", "tkey", "n", "mark")
    of_mark = slim.where(F.col("mark").isNotNull()).groupBy("mark").agg(F.min("doc_id").alias("low"), F.min(F.when(F.col("doc_id").isNull(), F.col("tkey"))).alias("key"))
    of_mark = stored(of_mark, "marks")
    joint = stored(of_mark.join(label, F.col("mark") == F.col("node")).select("mark", "component", "low", "key"), "joint")
    least = stored(joint.groupBy("component").agg(F.min("low").alias("c_low"), F.min("key").alias("c_key")).withColumnRenamed("component", "c_of"), "least")
    joint = joint.join(least, F.col("component") == F.col("c_of")).select(F.col("mark").alias("j_mark"), "c_low", "c_key")
    named = of_mark.join(joint, F.col("mark") == F.col("j_mark"), "left")
    linked_to = F.col("j_mark").isNotNull()
    named = named.select(F.col("mark").alias("m_mark"), F.when(linked_to, F.col("c_low")).otherwise(F.col("low")).alias("component_id"), F.when(linked_to, F.col("c_key")).otherwise(F.col("key")).alias("m_key"))
    named = stored(named, "named")
    for table in (links, label, of_mark, least):
        drop_stored(table)
    out = slim.join(named, F.col("mark") == F.col("m_mark"), "left")
    component = F.when(F.col("mark").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    nameless = F.col("doc_id").isNull() & F.col("component_id").isNull() & (F.col("mark").isNull() | (F.col("tkey") == F.col("m_key")))
    kept = F.coalesce(F.col("doc_id") == component, nameless)
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"), "tkey")


def without_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs less all but one document of each component, in docs' columns; of rows that repeat a doc_id and its text
    one stays, and of copies without a doc_id too. Null texts, empty tables and so on as in near_duplicates()."""
    kept = near_duplicates(docs, percent).where("kept").groupBy(F.col("doc_id").alias("k_doc"), F.col("tkey").alias("k_key")).agg(F.count("*").alias("k_rows"))
    kept = stored(kept, "kept")
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("r_doc"), F.xxhash64(text_of()).alias("r_key"))
    same = F.col("r_doc").eqNullSafe(F.col("k_doc")) & (F.col("r_key") == F.col("k_key"))
    again = kept.where("k_rows > 1")
    if again.isEmpty():
        return keyed.join(kept, same, "left_semi").select("row.*")
    one = keyed.join(again, same, "left_semi").groupBy("r_doc", "r_key").agg(F.first("row").alias("row"))
    return keyed.join(kept.where("k_rows = 1"), same, "left_semi").select("row.*").unionByName(one.select("row.*"))


#: The rows of near_duplicates() over `documents`, by all shingles that two documents share.
SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))
        WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT o.a, o.b FROM o JOIN c x ON x.doc_id = o.a JOIN c y ON y.doc_id = o.b WHERE 100 * o.k >= 85 * (x.n + y.n - o.k)),
r AS (SELECT a AS node, b AS seen FROM l UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen),
m AS (SELECT node, least(node, min(seen)) AS comp FROM r GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_shingles, coalesce(m.comp, d.doc_id) AS component_id, d.doc_id = coalesce(m.comp, d.doc_id) AS kept
FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN m ON m.node = d.doc_id
"""
