"""Whole runs over state tables that are laid out from the given tables first, against SQL over the same."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexispark.operators import classify
from lexispark.plans import runs
from lexispark.plans.registry import Tables, query
from lexispark.session import shared_dir

_CLEAN = "trim(translate({0}, '\",' || chr(13) || chr(10), '    '))"
_MATCH = "regexp_replace({0}, '[^A-Za-z0-9+%.>/&]', '', 'g')"

# Order lines are claim lines: N has not been processed, R waits for a review, A has one. Known texts are four of five
# parts' names with brands.
_STATE = f"""
WITH p AS (SELECT *, p_name || ' ' || p_brand AS known FROM part),
h AS (SELECT l_orderkey AS clm_id, l_linenumber AS clm_ln_id, CASE l_suppkey % 3 WHEN 0 THEN known || ',' WHEN 1 THEN replace(known, 'i', 'y') ELSE reverse(p_name) || lower(p_type) END AS orig_desc,
  CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS received_date, CASE WHEN l_returnflag = 'N' THEN 'Unprocessed' ELSE 'Processed' END AS processed_flag, CASE WHEN l_quantity < 40 THEN p_type END AS last_name, p_brand AS first_name,
  l_shipdate AS clm_rcv_dt, l_returnflag, l_discount FROM lineitem JOIN p ON p_partkey = l_partkey),
rep AS (SELECT clm_id, clm_ln_id, orig_desc, received_date, CASE l_returnflag WHEN 'R' THEN 'Pending' ELSE 'Approved' END AS rev_stat, l_discount * 10 AS conf_score FROM h WHERE l_returnflag <> 'N'),
work AS (SELECT * FROM h WHERE (processed_flag = 'Unprocessed' OR EXISTS (SELECT 1 FROM rep WHERE rev_stat = 'Pending' AND rep.clm_id = h.clm_id AND rep.clm_ln_id = h.clm_ln_id AND rep.orig_desc = h.orig_desc AND rep.received_date = h.received_date))
  AND NOT EXISTS (SELECT 1 FROM rep WHERE rev_stat <> 'Pending' AND rep.clm_id = h.clm_id AND rep.clm_ln_id = h.clm_ln_id AND rep.orig_desc = h.orig_desc AND rep.received_date = h.received_date)),
u AS (SELECT orig_desc, count(*) AS n FROM work GROUP BY 1),
k AS (SELECT known AS descr, md5(known) AS id, split_part(any_value(p_name), ' ', 2) AS cls FROM p WHERE p_partkey % 5 <> 0 GROUP BY 1),
e AS (SELECT u.orig_desc, arg_min(k.cls, k.id) AS cls FROM u JOIN k ON {_CLEAN.format('u.orig_desc')} = {_CLEAN.format('k.descr')} GROUP BY 1),
m AS (SELECT {_MATCH.format('descr')} AS kc, min(id) AS id, arg_min(cls, id) AS cls FROM k GROUP BY 1),
s AS (SELECT u.orig_desc, m.cls, m.id, round(jaro_similarity({_MATCH.format('u.orig_desc')}, m.kc), 2) AS jaro FROM u ANTI JOIN e USING (orig_desc) CROSS JOIN m),
f AS (SELECT orig_desc, max(jaro) AS jaro, arg_min(cls, struct_pack(x := -jaro, y := id)) AS cls FROM s WHERE jaro >= 0.85 GROUP BY 1),
x AS (SELECT u.*, CASE WHEN e.cls IS NOT NULL THEN 'exact' WHEN f.cls IS NOT NULL THEN 'fuzzy' ELSE 'none' END AS origin, coalesce(e.cls, f.cls, '') AS chrg_cls,
  CASE WHEN e.cls IS NOT NULL THEN 1.0 WHEN f.cls IS NULL THEN 0.0 WHEN f.jaro < 0.9 THEN 0.91 ELSE f.jaro END AS conf_score FROM u LEFT JOIN e USING (orig_desc) LEFT JOIN f USING (orig_desc))
"""


def _laid_out(t: Tables) -> str:
    """The tables of one classification run in a folder of their own."""
    root = f"{shared_dir(t.spark)}/run-{uuid.uuid4().hex}"
    known = F.concat_ws(" ", "p_name", "p_brand")
    lines = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    told = F.when(F.col("l_suppkey") % 3 == 0, F.concat(known, F.lit(","))).when(F.col("l_suppkey") % 3 == 1, F.translate(known, "i", "y")).otherwise(F.concat(F.reverse("p_name"), F.lower("p_type")))
    h = lines.select(
        F.col("l_orderkey").alias("clm_id"), F.col("l_linenumber").alias("clm_ln_id"), told.alias("orig_desc"), F.to_date("l_shipdate").cast("string").alias("received_date"),
        F.when(F.col("l_returnflag") == "N", "Unprocessed").otherwise("Processed").alias("processed_flag"), F.when(F.col("l_quantity") < 40, F.col("p_type")).alias("last_name"),
        F.col("p_brand").alias("first_name"), F.col("l_shipdate").alias("clm_rcv_dt"), "l_returnflag", "l_discount",
    )
    h.drop("l_returnflag", "l_discount").write.parquet(f"{root}/history")
    status = F.when(F.col("l_returnflag") == "R", "Pending").otherwise("Approved")
    h.where("l_returnflag <> 'N'").select(*runs.KEY, status.alias("rev_stat"), (F.col("l_discount") * 10).alias("conf_score")).write.parquet(f"{root}/report")
    part = t.part.where("p_partkey % 5 <> 0").groupBy(known.alias("orig_desc")).agg(F.first("p_name").alias("p_name"))
    part.select("orig_desc", F.split("p_name", " ")[1].alias("chrg_cls")).write.parquet(f"{root}/training")
    return root


@query("run_classification_report", _STATE + """
SELECT clm_id, clm_ln_id, orig_desc, received_date, CASE WHEN conf_score >= 0.95 THEN 'No Review Necessary' ELSE rev_stat END AS rev_stat, round(conf_score, 4) AS conf_score, NULL AS chrg_cls, NULL AS origin, NULL AS patient_nm, NULL AS exp_dt, NULL AS ftr1
FROM rep WHERE rev_stat <> 'Pending' OR NOT EXISTS (SELECT 1 FROM work WHERE rep.clm_id = work.clm_id AND rep.clm_ln_id = work.clm_ln_id AND rep.orig_desc = work.orig_desc AND rep.received_date = work.received_date)
UNION ALL SELECT clm_id, clm_ln_id, orig_desc, received_date, CASE WHEN conf_score >= 0.95 THEN 'No Review Necessary' ELSE 'Pending' END, conf_score, chrg_cls, origin,
  coalesce(last_name, '') || ', ' || first_name, CAST(CAST(clm_rcv_dt AS DATE) + 3 AS VARCHAR), split_part(lower(orig_desc), ' ', 1) FROM work JOIN x USING (orig_desc)""")
def _(t: Tables):
    root = _laid_out(t)
    runs.classification_run(t.spark, root, None, 0.95)
    out = t.spark.read.parquet(f"{root}/report")
    return out.select(*runs.KEY, "rev_stat", F.round("conf_score", 4).alias("conf_score"), "chrg_cls", "origin", "patient_nm", F.col("exp_dt").cast("string").alias("exp_dt"), "ftr1")


@query("run_classification_numbers", _STATE + """
SELECT CAST(sum(n) AS BIGINT) AS no_of_rec, count(*) AS unique_rec, CAST(sum(n) FILTER (origin <> 'exact') AS BIGINT) AS new_rec, count(*) FILTER (origin <> 'exact') AS unique_new_rec, count(DISTINCT nullif(chrg_cls, '')) AS no_of_chrg_cls, 1.0 AS high_conf_covg, 0 AS left_over FROM x""")
def _(t: Tables):
    """The numbers of the run, and how many lines it left unprocessed."""
    root = _laid_out(t)
    out = runs.classification_run(t.spark, root, None, 0.95)
    return out.crossJoin(t.spark.read.parquet(f"{root}/history").agg(F.count_if(F.col("processed_flag") == "Unprocessed").alias("left_over")))


# Orders are reviews of the texts of parts, customers ask for other classes; what the reviewers changed is put into corpora.
_TRAINING = """
WITH p AS (SELECT p_name || ' ' || p_brand AS orig_desc, min(p_type) AS chrg_cls FROM part WHERE p_partkey % 3 <> 0 GROUP BY 1),
q AS (SELECT DISTINCT p_partkey, p_name || ' ' || p_brand AS orig_desc, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part),
v AS (SELECT o_orderkey AS rev_id, q.*, CASE o_orderstatus WHEN 'F' THEN 'Pending' ELSE 'Approved' END AS rev_stat, o_orderpriority AS chrg_cls_new, o_totalprice / 500000 AS conf_score,
  CASE WHEN o_custkey % 4 = 0 THEN '' ELSE 'u' || o_custkey % 4 END AS updated_by, o_orderdate AS updated_date FROM orders JOIN q ON p_partkey = o_custkey),
r AS (SELECT c_acctbal AS rev_dt, c_custkey AS id, q.orig_desc, c_mktsegment AS chrg_cls_new FROM customer JOIN q ON p_partkey = c_custkey),
t AS (SELECT p.orig_desc, coalesce(arg_max(r.chrg_cls_new, struct_pack(a := rev_dt, b := id)), any_value(p.chrg_cls)) AS chrg_cls FROM p LEFT JOIN r USING (orig_desc) GROUP BY 1),
n AS (SELECT *, rank() OVER (PARTITION BY orig_desc ORDER BY updated_date DESC) AS k FROM v WHERE rev_stat = 'Approved'),
g AS (SELECT regexp_replace(regexp_replace(orig_desc, '[^A-Za-z0-9+%.>/&]', ' ', 'g'), ' {2,}', ' ', 'g') AS orig_desc, chrg_cls_new, updated_date, rev_id FROM n WHERE k = 1 AND (conf_score < 0.6 OR updated_by <> '')),
s AS (SELECT orig_desc, arg_max(chrg_cls_new, struct_pack(a := updated_date, b := rev_id)) AS chrg_cls FROM g GROUP BY 1),
c AS (SELECT a AS word, reverse(a) AS match, b AS surrounding_word, updated_by AS assignee, updated_date AS d, 1 AS s FROM v WHERE rev_stat = 'Approved' UNION ALL SELECT 'sol', n_name, 'x', 'old', TIMESTAMP '1990-01-01', 0 FROM nation),
w AS (SELECT *, row_number() OVER (PARTITION BY word, match, surrounding_word ORDER BY s DESC, d DESC, assignee DESC) AS i FROM c)
SELECT 'training' AS tab, coalesce(s.orig_desc, t.orig_desc) AS k, coalesce(s.chrg_cls, t.chrg_cls) AS a, CASE WHEN s.orig_desc IS NOT NULL THEN 'ONLINE' ELSE 'RETROSPECTIVE' END AS b, CASE WHEN s.orig_desc IS NOT NULL THEN '2026-01-02' ELSE '2000-01-01' END AS d FROM t FULL JOIN s ON s.orig_desc = t.orig_desc
UNION ALL SELECT 'spellings', word || ':' || match, surrounding_word, assignee, CAST(CAST(d AS DATE) AS VARCHAR) FROM w WHERE i = 1
UNION ALL SELECT 'classifiers', 'NaiveBayes', 'true', NULL, NULL
"""


@query("run_training_tables", _TRAINING)
def _(t: Tables):
    """What a training run leaves: its training table, its corpus of spellings, and the classifiers that it keeps."""
    root = f"{shared_dir(t.spark)}/run-{uuid.uuid4().hex}"
    known = F.concat_ws(" ", "p_name", "p_brand").alias("orig_desc")
    day = F.to_date(F.lit("2000-01-01"))
    p = t.part.where("p_partkey % 3 <> 0").groupBy(known).agg(F.min("p_type").alias("chrg_cls"))
    p.select("orig_desc", F.lower("orig_desc").alias("norm_desc"), "chrg_cls", F.lit("RETROSPECTIVE").alias("flag"), day.alias("create_dt")).write.parquet(f"{root}/training")
    q = t.part.select("p_partkey", known, F.split("p_name", " ")[0].alias("a"), F.split("p_name", " ")[1].alias("b"))
    v = t.orders.join(q, F.col("o_custkey") == F.col("p_partkey"))
    v.select(
        F.col("o_orderkey").alias("rev_id"), "orig_desc", F.concat_ws(" ", F.lit("solid"), "b").alias("norm_desc"), F.concat("a", F.lit(":solid")).alias("chngs"), F.concat_ws(" ", F.reverse("a"), "b").alias("norm_desc_new"), F.col("o_orderpriority").alias("chrg_cls_new"),
        F.when(F.col("o_orderstatus") == "F", "Pending").otherwise("Approved").alias("rev_stat"), (F.col("o_totalprice") / 500000).alias("conf_score"),
        F.when(F.col("o_custkey") % 4 == 0, "").otherwise(F.concat(F.lit("u"), F.col("o_custkey") % 4)).alias("updated_by"), F.col("o_orderdate").alias("updated_date"),
    ).write.parquet(f"{root}/reviews")
    t.customer.join(q, F.col("c_custkey") == F.col("p_partkey")).select("orig_desc", F.col("c_mktsegment").alias("chrg_cls_new"), F.col("c_acctbal").alias("rev_dt"), F.col("c_custkey").alias("unlearn_desc_id")).write.parquet(f"{root}/requests")
    corpus = t.nation.select(F.lit("sol").alias("word"), F.col("n_name").alias("match"), F.lit("x").alias("surrounding_word"), F.lit("old").alias("assignee"), F.lit("1990-01-01").cast("timestamp").alias("date"))
    corpus.write.parquet(f"{root}/spellings")
    corpus.limit(0).write.parquet(f"{root}/abbreviations")
    which = [c for c in classify.registry(False) if c.name == "NaiveBayes"]
    judged = runs.training_run(t.spark, root, f"{root}/models", "20260102000000", "2026-01-02", 0.6, which=which, least=10)
    nothing = F.lit(None).cast("string")
    at = lambda name: t.spark.read.parquet(f"{root}/{name}")
    corpora = at("spellings").unionByName(at("abbreviations"))
    return (
        at("training").select(F.lit("training").alias("tab"), F.col("orig_desc").alias("k"), F.col("chrg_cls").alias("a"), F.col("flag").alias("b"), F.col("create_dt").cast("string").alias("d"))
        .unionByName(corpora.select(F.lit("spellings").alias("tab"), F.concat_ws(":", "word", "match").alias("k"), F.col("surrounding_word").alias("a"), F.col("assignee").alias("b"), F.to_date("date").cast("string").alias("d")))
        .unionByName(judged.select(F.lit("classifiers").alias("tab"), F.col("clf").alias("k"), F.col("keep").cast("string").alias("a"), nothing.alias("b"), nothing.alias("d")))
    )
