"""Dialogues from each speaker's side: that speaker as assistant, the others as named users, with masks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _same(x: str, y: str, *names: str) -> Column:
    """All these columns of the two aliases are equal, nulls among them."""
    return reduce(lambda a, b: a & b, (F.col(f"{x}.{n}").eqNullSafe(F.col(f"{y}.{n}")) for n in names))


def _bucketed(rows: DataFrame, turns_a_bucket: int) -> DataFrame:
    """rows (conv_id, turn, digest, ...) with a `bucket` that grows with (turn, digest), of about `turns_a_bucket` rows:
    a block of turns, cut before and behind turns of more rows than that, which are cut by their digests."""
    block = F.coalesce(F.floor(F.col("turn") / F.lit(turns_a_bucket)), F.lit(-(2**53)))
    key = F.coalesce("turn", F.lit(-(2**63) + 1))
    rows = rows.withColumn("block", block).withColumn("key", key)
    hot = rows.groupBy("conv_id", "block", "key").agg(F.count("*").alias("n")).where(F.col("n") > turns_a_bucket)
    hot = hot.groupBy("conv_id", "block").agg(F.collect_list(F.struct("key", F.ceil(F.col("n") / turns_a_bucket).alias("parts"))).alias("hot"))
    r, h = rows.alias("r"), hot.alias("h")
    full = r.join(h, _same("r", "h", "conv_id", "block"), "left").select("r.*", F.coalesce("hot", F.array().cast("array<struct<key:bigint,parts:bigint>>")).alias("hot"))
    own = F.get(F.filter("hot", lambda x: x["key"] == F.col("key")), F.lit(0))
    below = F.array_max(F.transform(F.filter("hot", lambda x: x["key"] < F.col("key")), lambda x: x["key"]))
    part = F.floor(F.conv(F.substring("digest", 1, 8), 16, 10).cast("double") / 2.0**32 * own["parts"])
    behind = F.struct("block", F.coalesce(below, F.lit(-(2**63))).alias("key"), F.lit(1).alias("behind"), F.lit(0).cast("long").alias("part"))
    bucket = F.when(own.isNull(), behind).otherwise(F.struct("block", F.col("key").alias("key"), F.lit(0).alias("behind"), part.cast("long").alias("part")))
    return full.withColumn("bucket", bucket).drop("hot", "block", "key")


def perspectives(turns: DataFrame, turns_a_bucket: int = 1000, speaker: str = "role") -> DataFrame:
    """One row for each dialogue, each of its speakers (viewer) and each turn, in long form, so that a dialogue of
    any length is never held in one place: conv_id, viewer, turn, place, rendered_role, name, rendered, trained,
    char_start, char_end, mask_start, mask_end.

    `place` counts the turns from 0 by turn, then by a digest of speaker and text. A turn is rendered as
    `<|role name|>\\ntext<|end|>\\n`; the rendered dialogue is these strings in order, char_start and char_end are a
    turn's code points in it. `trained` is 1 for the viewer's own turns, whose text and end mark are mask_start to
    mask_end; the others' are empty, at their start. A null speaker is called `unknown`, a null text is empty, a null
    turn comes first, rows without a conv_id are one dialogue; equal rows stay separate turns; other columns are
    ignored; no rows give no rows.

    Places and offsets are worked out on digests and lengths, equal rows as one with their number, by sums over
    buckets of bounded size; the texts are dealt out once, each to its digest."""
    t = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col(speaker).cast("string"), F.lit("unknown")).alias("speaker"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    t = t.withColumn("digest", F.md5(F.concat("speaker", F.lit("\x00"), "text")))
    slim = t.groupBy("conv_id", "turn", "speaker", "digest", F.length("text").alias("size")).agg(F.count("*").alias("copies"))
    slim = _bucketed(slim, turns_a_bucket)
    viewers = slim.select("conv_id", F.col("speaker").alias("viewer")).distinct()
    seen = slim.alias("a").join(viewers.alias("b"), _same("a", "b", "conv_id")).select("a.*", "viewer")
    own = F.col("speaker") == F.col("viewer")
    before, behind = F.length(F.lit("<|assistant|>\n")), F.length(F.lit("<|end|>\n"))
    seen = seen.withColumn("head", F.when(own, before).otherwise(F.length("speaker") + len("<|user |>\n")))
    seen = seen.withColumn("n", F.col("head") + F.col("size") + behind)
    each = ["conv_id", "viewer"]
    sums = seen.groupBy(*each, "bucket").agg(F.sum(F.col("n") * F.col("copies")).alias("bn"), F.sum("copies").alias("bc"))
    earlier = W.partitionBy(*each).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*each, "bucket", F.coalesce(F.sum("bn").over(earlier), F.lit(0)).alias("bn"), F.coalesce(F.sum("bc").over(earlier), F.lit(0)).alias("bc"))
    order = W.partitionBy(*each, "bucket").orderBy("turn", "digest").rowsBetween(W.unboundedPreceding, -1)
    seen = seen.withColumn("at", F.coalesce(F.sum("copies").over(order), F.lit(0))).withColumn("upto", F.coalesce(F.sum(F.col("n") * F.col("copies")).over(order), F.lit(0)))
    slots = seen.alias("x").join(sums.alias("y"), _same("x", "y", *each, "bucket")).select("x.*", "y.bn", "y.bc")
    slots = slots.select("conv_id", "turn", "digest", "viewer", "head", "n", "copies", (F.col("bc") + F.col("at")).alias("at"), (F.col("bn") + F.col("upto")).alias("start"))
    texts = t.groupBy("conv_id", "turn", "digest").agg(F.first("speaker").alias("speaker"), F.first("text").alias("text"))
    full = texts.alias("x").join(slots.alias("y"), _same("x", "y", "conv_id", "turn", "digest")).select("x.conv_id", "x.turn", "speaker", "text", "viewer", "head", "n", "at", "start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("k"))
    start = F.col("start") + F.col("k") * F.col("n")
    end = start + F.col("n")
    head = F.when(own, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user "), F.col("speaker"), F.lit("|>\n")))
    return full.select(
        "conv_id", "viewer", "turn", (F.col("at") + F.col("k")).cast("long").alias("place"),
        F.when(own, F.lit("assistant")).otherwise(F.lit("user")).alias("rendered_role"), F.when(~own, F.col("speaker")).alias("name"),
        F.concat(head, "text", F.lit("<|end|>\n")).alias("rendered"), own.cast("int").alias("trained"), start.cast("long").alias("char_start"), end.cast("long").alias("char_end"),
        F.when(own, start + F.col("head")).otherwise(start).cast("long").alias("mask_start"), F.when(own, end - 1).otherwise(start).cast("long").alias("mask_end"),
    )


def dialogues(turns: DataFrame, **options) -> DataFrame:
    """Whole rendered dialogues: conv_id, viewer, text, masks (start and end of what is trained on, in order).

    For dialogues that fit into a row; perspectives() has no such bound."""
    rows = perspectives(turns, **options)
    parts = F.array_sort(F.collect_list(F.struct("place", "rendered")))
    masks = F.array_sort(F.collect_list(F.when(F.col("trained") == 1, F.struct("mask_start", "mask_end"))))
    rows = rows.groupBy("conv_id", "viewer").agg(parts.alias("parts"), masks.alias("masks"))
    return rows.select("conv_id", "viewer", F.array_join(F.transform("parts", lambda p: p["rendered"]), "").alias("text"), "masks")


#: The rows of perspectives() over `conversations`.
SQL = """
WITH t AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
v AS (SELECT DISTINCT conv_id, speaker AS viewer FROM t),
s AS (SELECT t.*, v.viewer, CASE WHEN t.speaker = v.viewer THEN '<|assistant|>' || chr(10) ELSE '<|user ' || t.speaker || '|>' || chr(10) END AS head
      FROM t JOIN v ON t.conv_id IS NOT DISTINCT FROM v.conv_id),
r AS (SELECT *, head || text || '<|end|>' || chr(10) AS rendered FROM s),
p AS (SELECT *, length(rendered) AS n, row_number() OVER w - 1 AS place,
        sum(length(rendered)) OVER (PARTITION BY conv_id, viewer ORDER BY turn NULLS FIRST, md5(speaker || chr(0) || text) ROWS UNBOUNDED PRECEDING) AS fin
      FROM r WINDOW w AS (PARTITION BY conv_id, viewer ORDER BY turn NULLS FIRST, md5(speaker || chr(0) || text)))
SELECT conv_id, viewer, turn, place, CASE WHEN speaker = viewer THEN 'assistant' ELSE 'user' END AS rendered_role,
  CASE WHEN speaker <> viewer THEN speaker END AS name, rendered, CAST(speaker = viewer AS INTEGER) AS trained,
  CAST(fin - n AS BIGINT) AS char_start, CAST(fin AS BIGINT) AS char_end,
  CAST(CASE WHEN speaker = viewer THEN fin - n + length(head) ELSE fin - n END AS BIGINT) AS mask_start,
  CAST(CASE WHEN speaker = viewer THEN fin - 1 ELSE fin - n END AS BIGINT) AS mask_end
FROM p
"""
