"""Joins, states, aggregates, windows, sets and samples over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexispark.functions import text
from lexispark.operators import classify, fuzzy, sampling
from lexispark.operators import lifecycle as life
from lexispark.plans import pipeline
from lexispark.plans.queries_text import T1
from lexispark.plans.registry import Tables, query
from lexispark.session import shared_dir, stored
from lexispark.sources import io
from lexispark.streaming import incremental

_KEYED = f"WITH d AS (SELECT doc_id, {T1.format('text')} AS k FROM documents), n AS (SELECT d.* FROM d ANTI JOIN labels USING (doc_id)), t AS (SELECT d.doc_id AS train_id, k, toxic FROM d JOIN labels USING (doc_id)) "


def known_texts(t: Tables):
    """New texts (doc_id, k), which have no label, and known ones (train_id, k, toxic); k stands for the cleaned text."""
    d = stored(t.documents.select("doc_id", text.text_key(text.charset_clean("text")).alias("k")), "keys")  # texts are read once
    return d.join(t.labels, "doc_id", "left_anti"), d.join(t.labels, "doc_id").select(F.col("doc_id").alias("train_id"), "k", "toxic")


@query("J1_exact_match", _KEYED + "SELECT n.doc_id, t.train_id, t.toxic, 1.0::DOUBLE AS conf_score FROM n JOIN t USING (k)")
def _(t: Tables):
    new, known = known_texts(t)
    return fuzzy.exact_matches(new, known, ["k"]).select("doc_id", "train_id", "toxic", F.lit(1.0).alias("conf_score"))


@query("J2_unmatched", _KEYED + "SELECT n.doc_id FROM n ANTI JOIN t USING (k)")
def _(t: Tables):
    new, known = known_texts(t)
    return fuzzy.unmatched(new, known, ["k"]).select("doc_id")


@query("A5_run_metrics", _KEYED + """, r AS (SELECT n.k, n.k IN (SELECT k FROM t) AS known FROM n)
SELECT count(*) AS no_of_rec, count(DISTINCT k) AS unique_rec, count(*) FILTER (NOT known) AS new_rec, count(DISTINCT k) FILTER (NOT known) AS unique_new_rec, round(count(*) FILTER (known) / count(*), 6) AS high_conf_covg FROM r""")
def _(t: Tables):
    new, known = known_texts(t)
    hit = new.join(known.select("k").distinct().withColumn("hit", F.lit(True)), "k", "left").withColumn("known", F.coalesce("hit", F.lit(False)))
    return life.run_metrics(hit.withColumn("conf", F.when(F.col("known"), 1.0).otherwise(0.0)), "k", "conf", "known")


_CLEAN = "trim(translate({0}, '\",' || chr(13) || chr(10), '    '))"
_MATCH = "regexp_replace({0}, '[^A-Za-z0-9+%.>/&]', '', 'g')"


def part_lines(t: Tables):
    """Lines to classify (p_partkey, descr), some as known, some with other signs, some unlike all, and known lines with
    their class: the part's second word."""
    p = t.part.withColumn("known", F.concat_ws(" ", "p_name", "p_brand"))
    other = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.col("known"), F.lit(","))).when(F.col("p_partkey") % 3 == 1, F.regexp_replace("known", "i", "y")).otherwise(F.concat_ws(" ", F.reverse("p_name"), F.lower("p_brand"), F.lower("p_type")))
    lines = p.where("p_partkey % 5 = 0").select("p_partkey", other.alias("descr"))
    return lines, p.where("p_partkey % 5 <> 0").select("p_partkey", F.col("known").alias("descr"), F.element_at(F.split("p_name", " "), 2).alias("cls"))


# Exact matches, else the most similar known line from 0.85 on, else the vote of two text classifiers.
@query("pipeline_classify", f"""
WITH p AS (SELECT *, p_name || ' ' || p_brand AS known FROM part),
n AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN known || ',' WHEN 1 THEN replace(known, 'i', 'y') ELSE reverse(p_name) || ' ' || lower(p_brand) || ' ' || lower(p_type) END AS descr FROM p WHERE p_partkey % 5 = 0),
k AS (SELECT known AS descr, min(p_partkey) AS idx, split_part(arg_min(p_name, p_partkey), ' ', 2) AS cls FROM p WHERE p_partkey % 5 <> 0 GROUP BY 1),
e AS (SELECT n.p_partkey, arg_min(k.cls, k.idx) AS cls FROM n JOIN k ON {_CLEAN.format('n.descr')} = {_CLEAN.format('k.descr')} GROUP BY 1),
r AS (SELECT DISTINCT {_MATCH.format('descr')} AS c FROM n ANTI JOIN e USING (p_partkey)),
m AS (SELECT {_MATCH.format('descr')} AS kc, min(idx) AS idx, arg_min(cls, idx) AS cls, min(descr) AS d FROM k GROUP BY 1),
s AS (SELECT r.c, m.cls, m.idx, m.d, round(jaro_similarity(r.c, m.kc), 2) AS jaro, round(1 - damerau_levenshtein(r.c, m.kc) / greatest(length(r.c), length(m.kc)), 2) AS dl FROM r, m),
j AS (SELECT c, max(jaro) AS prob, arg_min(cls, struct_pack(x := -jaro, y := idx)) AS cls FROM s GROUP BY 1),
l AS (SELECT c, max(dl) AS prob, arg_min(cls, struct_pack(x := -dl, y := d, z := idx)) AS cls FROM s GROUP BY 1),
v AS (SELECT j.c, j.prob AS jaro, j.cls AS jcls, l.cls AS lcls, CASE WHEN j.prob >= 0.8 AND j.prob < 0.85 THEN 0.85 ELSE j.prob END AS jp,
  CASE WHEN l.prob >= 0.8 AND l.prob < 0.9 THEN 0.96 WHEN l.prob >= 0.7 AND l.prob < 0.8 THEN 0.93 WHEN l.prob >= 0.6 AND l.prob < 0.7 THEN 0.88 WHEN l.prob >= 0.5 AND l.prob < 0.6 THEN 0.81 ELSE l.prob END AS lp FROM j JOIN l USING (c)),
w AS (SELECT *, CASE WHEN jcls = lcls THEN jcls WHEN round(jp, 9) > round(lp, 9) THEN jcls WHEN round(jp, 9) < round(lp, 9) THEN lcls ELSE least(jcls, lcls) END AS cls FROM v),
o AS (SELECT n.p_partkey, n.descr, e.cls AS ecls, CASE WHEN e.cls IS NOT NULL THEN 'exact' WHEN w.jaro >= 0.85 THEN 'fuzzy' ELSE 'vote' END AS origin, w.* FROM n LEFT JOIN e USING (p_partkey) LEFT JOIN w ON e.cls IS NULL AND w.c = {_MATCH.format('n.descr')}),
f AS (SELECT p_partkey, descr, origin, CASE origin WHEN 'exact' THEN ecls WHEN 'fuzzy' THEN jcls ELSE cls END AS chrg_cls,
  round(CASE origin WHEN 'exact' THEN 1.0 WHEN 'fuzzy' THEN CASE WHEN jaro < 0.9 THEN 0.91 ELSE jaro END ELSE (CASE WHEN jcls = cls THEN jp ELSE 0 END + CASE WHEN lcls = cls THEN lp ELSE 0 END) / 4 END, 4) AS conf_score,
  CASE origin WHEN 'vote' THEN CASE WHEN jcls = lcls THEN 'Jaro, DLevenshtein' WHEN jcls = cls THEN 'Jaro' ELSE 'DLevenshtein' END ELSE '' END AS algorithms FROM o)
SELECT *, CASE WHEN conf_score >= 0.9 THEN 'No Review Necessary' ELSE 'Pending' END AS rev_stat FROM f""")
def _(t: Tables):
    lines, known = part_lines(t)
    trained = pipeline.train(known, "descr", "cls", "p_partkey", [c for c in classify.registry() if c.on_text])
    found = pipeline.classify_lines(lines, known, trained, "descr", "cls", "p_partkey")
    return pipeline.classification_report(lines, found, "cls", "p_partkey")


@query("pipeline_saved_models")
def _(t: Tables):
    """The whole live set of classifiers, trained, saved, loaded again, and put to the vote on lines that match nothing."""
    lines, known = part_lines(t)
    root = f"{shared_dir(t.spark)}/models-{uuid.uuid4().hex}"
    concepts = {"colour": ["red", "blue"], "part": ["bolt", "gear"]}
    pipeline.train(known, "descr", "cls", "p_partkey", concepts=concepts, size=16).save(t.spark, root, "20200101000000")
    trained = pipeline.Trained.load(t.spark, root, [c.name for c in classify.registry()])
    found = pipeline.classify_lines(lines, known, trained, "descr", "cls", "p_partkey", least=2.0)
    return pipeline.classification_report(lines, found, "cls", "p_partkey")


@query("F2_unprocessed", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O'")
def _(t: Tables):
    return t.orders.where("o_orderstatus = 'O'").select("o_orderkey", "o_totalprice")


@query("F3_auto_approved", "SELECT o_orderkey, CASE WHEN o_totalprice / 500000 >= 0.6 THEN 'No Review Necessary' ELSE o_orderstatus END AS rev_stat FROM orders")
def _(t: Tables):
    return t.orders.select("o_orderkey", life.auto_approved(F.col("o_totalprice") / 500000, 0.6, F.col("o_orderstatus")).alias("rev_stat"))


@query("F4_threshold", "SELECT o_orderkey FROM orders WHERE o_totalprice >= (SELECT c_acctbal * 50 FROM customer WHERE c_custkey = 7)")
def _(t: Tables):
    config = t.customer.where("c_custkey = 7").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("threshold_value"))
    return t.orders.where(F.col("o_totalprice") >= 50 * life.threshold_of(config, "Customer#000000007", 0.0)).select("o_orderkey")


@query("F5_clamped", "SELECT event_id, greatest(0, least(1, try_cast(replace(event_type, 'view', '') || CAST(value / 100 AS VARCHAR) AS DOUBLE))) AS threshold FROM events WHERE event_type = 'view' UNION ALL SELECT event_id, NULL FROM events WHERE event_type <> 'view'")
def _(t: Tables):
    said = F.concat(F.regexp_replace("event_type", "view", ""), (F.col("value") / 100).cast("string"))
    return t.events.select("event_id", life.clamped(said).alias("threshold"))


@query("F6_review_gate", "SELECT o_orderkey FROM orders WHERE o_totalprice / 5000 < 90 OR (o_totalprice / 5000 >= 90 AND (CASE o_orderstatus WHEN 'O' THEN 'u1' WHEN 'F' THEN '' END) NOT IN (' ', ''))")
def _(t: Tables):
    by = F.when(F.col("o_orderstatus") == "O", "u1").when(F.col("o_orderstatus") == "F", "")
    return t.orders.where(life.review_gate(F.col("o_totalprice") / 5000, by, 90)).select("o_orderkey")


@query("F7_changed_text", "SELECT p_partkey FROM part WHERE p_name <> CASE WHEN p_size < 25 THEN p_name WHEN p_size < 40 THEN p_type END AND p_type = 'ECONOMY'")
def _(t: Tables):
    old = F.when(F.col("p_size") < 25, F.col("p_name")).when(F.col("p_size") < 40, F.col("p_type"))
    status = F.when(F.col("p_type") == "ECONOMY", "Approved").otherwise("Pending")
    return t.part.where(life.changed_text(F.col("p_name"), old, status)).select("p_partkey")


@query("F8_report_columns", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + 3 AS VARCHAR) AS exp_dt, coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END, '') || ', ' || o_orderstatus AS patient_nm FROM orders")
def _(t: Tables):
    last = F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority"))
    return t.orders.select("o_orderkey", F.date_add(F.to_date("o_orderdate"), 3).cast("string").alias("exp_dt"), life.person_name(last, F.col("o_orderstatus")).alias("patient_nm"))


@query("F12_upload_columns", "SELECT doc_id, coalesce(CAST(quality AS VARCHAR), '') AS quality, coalesce(CAST(toxic AS VARCHAR), '') AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def _(t: Tables):
    d = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return d.select("doc_id", F.col("quality").cast("string").alias("quality"), F.col("toxic").cast("string").alias("toxic")).na.fill("")


@query("J3_report_join", "SELECT o_orderkey, coalesce(l_linenumber, 0) AS l_linenumber, coalesce(l_returnflag, '') AS l_returnflag FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O'")
def _(t: Tables):
    o, line = t.orders.where("o_orderstatus = 'O'"), t.lineitem
    return o.join(line, o["o_orderkey"] == line["l_orderkey"], "left").select("o_orderkey", F.coalesce("l_linenumber", F.lit(0)).alias("l_linenumber"), F.coalesce("l_returnflag", F.lit("")).alias("l_returnflag"))


@query("J4_flag_processed", "SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 'Processed' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def _(t: Tables):
    done = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return life.flagged(t.orders.select("o_orderkey", "o_orderstatus"), done, ["o_orderkey"], "o_orderstatus", "Processed")


@query("J5_requeue_pending", "SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O' AND l_quantity > 40) THEN 'Unprocessed' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def _(t: Tables):
    pending = t.lineitem.where("l_linestatus = 'O' and l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"))
    return life.flagged(t.orders.select("o_orderkey", "o_orderstatus"), pending, ["o_orderkey"], "o_orderstatus", "Unprocessed")


@query("J6_delete_pending", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')")
def _(t: Tables):
    return life.without(t.orders.select("o_orderkey"), t.lineitem.where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@query("J7_new_counts", "SELECT count(*) AS n_new, count(DISTINCT o_custkey) AS n_unique_new FROM orders ANTI JOIN lineitem ON l_orderkey = o_orderkey")
def _(t: Tables):
    o, line = t.orders, t.lineitem
    return o.join(line, o["o_orderkey"] == line["l_orderkey"], "left_anti").agg(F.count("*").alias("n_new"), F.count_distinct("o_custkey").alias("n_unique_new"))


@query("J8_unlearn_relabel", "SELECT c_custkey, coalesce(arg_max(o_orderpriority, struct_pack(a := o_orderdate, b := o_orderkey)), c_mktsegment) AS c_mktsegment FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_mktsegment")
def _(t: Tables):
    asked = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority", "o_orderdate", "o_orderkey")
    return life.relabelled(t.customer.select("c_custkey", "c_mktsegment"), asked, "c_custkey", "c_mktsegment", "o_orderpriority", ["o_orderdate", "o_orderkey"])


@query("J9_latest_reviews", "SELECT o_orderkey, o_custkey FROM (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) AS r FROM orders) WHERE r = 1")
def _(t: Tables):
    return life.newest(t.orders, ["o_custkey"], "o_orderdate").select("o_orderkey", "o_custkey")


@query("J10_upsert", """
WITH s AS (SELECT l_orderkey AS k, 'ONLINE' AS flag, round(sum(l_extendedprice), 2) AS amount FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1)
SELECT coalesce(s.k, o_orderkey) AS k, CASE WHEN s.k IS NOT NULL THEN s.flag ELSE 'RETROSPECTIVE' END AS flag, CASE WHEN s.k IS NOT NULL THEN s.amount ELSE o_totalprice END AS amount
FROM (SELECT * FROM orders WHERE o_orderstatus <> 'P') o FULL JOIN s ON s.k = o_orderkey""")
def _(t: Tables):
    target = t.orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("k"), F.lit("RETROSPECTIVE").alias("flag"), F.col("o_totalprice").alias("amount"))
    source = t.lineitem.where("l_returnflag = 'N'").groupBy(F.col("l_orderkey").alias("k")).agg(F.lit("ONLINE").alias("flag"), F.round(F.sum("l_extendedprice"), 2).alias("amount"))
    return life.upserted(target, source, "k")


@query("J11_agreeing_reviews", "SELECT l_orderkey, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 1")
def _(t: Tables):
    return life.agreed(t.lineitem, "l_orderkey", "l_returnflag")


@query("A1_filtered_count", "SELECT count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS n_returned FROM lineitem")
def _(t: Tables):
    return t.lineitem.agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("n_returned"))


@query("A2_distinct_counts", "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem")
def _(t: Tables):
    return t.lineitem.agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("A3_latest_dates", "SELECT o_custkey, CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) AS last_date FROM orders GROUP BY 1")
def _(t: Tables):
    return t.orders.groupBy("o_custkey").agg(F.to_date(F.max("o_orderdate")).cast("string").alias("last_date"))


@query("A4_class_histogram", "SELECT p_name, count(*) AS n, count(*) < 30 AS below FROM part GROUP BY 1")
def _(t: Tables):
    return t.part.groupBy("p_name").agg(F.count("*").alias("n")).withColumn("below", F.col("n") < 30)


@query("A6_flag_ratio", "SELECT CASE WHEN count(*) FILTER (o_orderstatus = 'P') > 0 THEN round(count(*) FILTER (o_orderstatus = 'O') / count(*) FILTER (o_orderstatus = 'P'), 6) ELSE -9.9 END AS ratio FROM orders")
def _(t: Tables):
    return life.flag_ratio(t.orders, "o_orderstatus", "O", "P")


@query("W1_first_per_key", "SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber) AS r FROM lineitem) WHERE r = 1")
def _(t: Tables):
    return life.first_per_key(t.lineitem, ["l_orderkey"], F.col("l_extendedprice"), F.col("l_linenumber")).select("l_orderkey", "l_linenumber")


@query("W2_latest_with_ties", "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, rank() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC) AS r FROM lineitem) WHERE r = 1")
def _(t: Tables):
    return life.newest(t.lineitem, ["l_orderkey"], "l_shipdate").select("l_orderkey", "l_linenumber", "l_partkey")


@query("W3_top_two", "SELECT p_brand, p_type, n FROM (SELECT p_brand, p_type, count(*) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS r FROM part GROUP BY 1, 2) WHERE r <= 2")
def _(t: Tables):
    from pyspark.sql import Window as W

    n = t.part.groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    return n.withColumn("r", F.row_number().over(W.partitionBy("p_brand").orderBy(F.desc("n"), "p_type"))).where("r <= 2").drop("r")


@query("W4_argmax", "SELECT o_custkey, arg_max(o_orderkey, struct_pack(a := o_totalprice, b := -o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def _(t: Tables):
    return t.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("o_orderkey"))


@query("W5_corpus_merge", """
SELECT k, word, k2 FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s DESC, d DESC, k2 DESC) AS r FROM (
  SELECT o_custkey AS k, o_orderpriority AS word, o_orderdate AS d, o_orderkey AS k2, 0 AS s FROM orders WHERE o_orderstatus <> 'O'
  UNION ALL SELECT o_custkey, o_orderpriority, o_orderdate, o_orderkey, 1 FROM orders WHERE o_orderstatus = 'O')) WHERE r = 1""")
def _(t: Tables):
    o = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("word"), F.col("o_orderdate").alias("d"), F.col("o_orderkey").alias("k2"), "o_orderstatus")
    old, new = o.where("o_orderstatus <> 'O'").drop("o_orderstatus"), o.where("o_orderstatus = 'O'").drop("o_orderstatus")
    return life.corpus_merged(old, new, ["k"], "d", "k2").select("k", "word", "k2")


@query("O1_newest_n", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 1500")
def _(t: Tables):
    return t.orders.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(1500).select("o_orderkey")


@query("O2_ordered", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS o_orderdate FROM orders ORDER BY orders.o_orderdate, o_orderkey")
def _(t: Tables):
    return t.orders.select("o_orderkey", F.to_date("o_orderdate").cast("string").alias("o_orderdate")).orderBy("o_orderdate", "o_orderkey")


@query("O3_tie_by_text", "SELECT p_brand, min(p_name) AS p_name FROM (SELECT *, max(p_size) OVER (PARTITION BY p_brand) AS top FROM part) WHERE p_size = top GROUP BY 1")
def _(t: Tables):
    return t.part.groupBy("p_brand").agg(F.min(F.struct(-F.col("p_size"), "p_name")).alias("s")).select("p_brand", "s.p_name")


@query("U1_union_all", "SELECT o_custkey AS k FROM orders UNION ALL SELECT c_custkey FROM customer")
def _(t: Tables):
    return t.orders.select(F.col("o_custkey").alias("k")).unionByName(t.customer.select(F.col("c_custkey").alias("k")))


@query("U2_distinct", "SELECT DISTINCT l_partkey, l_returnflag FROM lineitem")
def _(t: Tables):
    return t.lineitem.select("l_partkey", "l_returnflag").distinct()


@query("U3_keep_first_last", "SELECT l_orderkey, min(l_linenumber) AS first_line, max(l_linenumber) AS last_line FROM lineitem GROUP BY 1")
def _(t: Tables):
    first = life.first_per_key(t.lineitem.select("l_orderkey", F.col("l_linenumber").alias("first_line")), ["l_orderkey"], F.col("first_line"))
    last = life.first_per_key(t.lineitem.select("l_orderkey", F.col("l_linenumber").alias("last_line")), ["l_orderkey"], F.col("last_line").desc())
    return first.join(last, "l_orderkey")


@query("S1_S2_csv_round_trip", "SELECT p_partkey, p_name, p_size FROM part")
def _(t: Tables):
    path = f"{shared_dir(t.spark)}/csv-{uuid.uuid4().hex}"
    io.write_csv(t.part.select("p_partkey", "p_name", "p_size"), path)
    return io.read_csv(t.spark, path, "p_partkey long, p_name string, p_size int")


@query("S8_tsv_round_trip", "SELECT c_custkey, c_name FROM customer")
def _(t: Tables):
    path = f"{shared_dir(t.spark)}/tsv-{uuid.uuid4().hex}"
    io.write_csv(t.customer.select("c_custkey", "c_name"), path, "\t")
    return io.read_csv(t.spark, path, "c_custkey long, c_name string", "\t")


@query("S3_table_scan", "SELECT n_nationkey, n_name FROM nation")
def _(t: Tables):
    return io.read_table(t.spark, f"{t.folder}/nation.parquet").select("n_nationkey", "n_name")


@query("S4_concepts", "SELECT s_name AS concept, len(string_split(s_name, '#')) AS n FROM supplier")
def _(t: Tables):
    path = f"{shared_dir(t.spark)}/concepts-{uuid.uuid4().hex}"
    t.supplier.select(F.col("s_name").alias("concept"), F.regexp_replace("s_name", "#", ",").alias("key_words")).write.parquet(path)
    return io.read_concepts(t.spark, path).select("concept", F.size("keywords").cast("long").alias("n"))


@query("S5_S9_append_replace", "SELECT r_regionkey FROM region UNION ALL SELECT r_regionkey FROM region")
def _(t: Tables):
    path = f"{shared_dir(t.spark)}/table-{uuid.uuid4().hex}"
    one = t.region.select("r_regionkey")
    io.append(t.region.select((F.col("r_regionkey") + 100).cast("long").alias("r_regionkey")), path)
    io.replace(one, path)
    io.append(one, path)
    return t.spark.read.parquet(path)


@query("S10_conditional_delete", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
def _(t: Tables):
    return life.without(t.orders.select("o_orderkey", "o_orderstatus"), t.orders.where("o_orderstatus = 'F'"), ["o_orderkey"]).select("o_orderkey")


@query("S12_page_links", """SELECT page_id, target, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages) GROUP BY 1, 2""")
def _(t: Tables):
    return io.links(t.pages)


_DRAW = "(({0}) * 7919 + 786) % 10007"


@query("P1_upsample", f"""
WITH b AS (SELECT p_partkey, p_name || p_brand AS cls, count(*) OVER (PARTITION BY p_name || p_brand) AS n, row_number() OVER (PARTITION BY p_name || p_brand ORDER BY {_DRAW.format('p_partkey')}, p_partkey) - 1 AS r FROM part)
SELECT p_partkey, cls, CAST(unnest(range(0, CASE WHEN n >= 10 THEN 1 ELSE 1 + CAST(floor((9 - r) / n) AS BIGINT) END)) AS INTEGER) AS copy FROM b""")
def _(t: Tables):
    return sampling.upsampled(t.part.select("p_partkey", F.concat("p_name", "p_brand").alias("cls")), "cls", "p_partkey")


@query("P2_hold_out", f"SELECT o_orderkey, CASE WHEN {_DRAW.format('o_orderkey')} < 1001 THEN 'test' ELSE 'train' END AS part FROM orders")
def _(t: Tables):
    train, test = sampling.hold_out(t.orders.select("o_orderkey"), "o_orderkey")
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


# The same on keys that are texts.
_TEXT_DRAW = "CAST('0x' || left(md5('786:' || coalesce({0}, '')), 8) AS BIGINT) % 10007"


@query("P2_hold_out_text_keys", f"SELECT c_name, CASE WHEN {_TEXT_DRAW.format('c_name')} < 1001 THEN 'test' ELSE 'train' END AS part FROM customer")
def _(t: Tables):
    train, test = sampling.hold_out(t.customer.select("c_name"), "c_name")
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query("P5_folds_text_keys", f"SELECT c_name, CAST((row_number() OVER (PARTITION BY c_mktsegment ORDER BY {_TEXT_DRAW.format('c_name')}, c_name) - 1) % 5 AS INTEGER) AS fold FROM customer")
def _(t: Tables):
    return sampling.folds(t.customer.select("c_name", "c_mktsegment"), "c_mktsegment", "c_name").select("c_name", "fold")


@query("P3_resplit", f"SELECT o_orderkey, o_orderstatus FROM orders WHERE {_DRAW.format('o_orderkey')} < 1001")
def _(t: Tables):
    return sampling.hold_out_with_classes(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus")[1]


@query("P4_stratified_sample", f"""
WITH b AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_DRAW.format('o_orderkey')}, o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderstatus) AS n, count(*) OVER () AS total FROM orders)
SELECT o_orderkey, o_orderstatus FROM b WHERE total <= 1500 OR r <= round(n * 1000 / total)""")
def _(t: Tables):
    return sampling.stratified(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey", 1000)


@query("P5_P6_folds", f"SELECT o_orderkey, CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_DRAW.format('o_orderkey')}, o_orderkey) - 1) % 5 AS INTEGER) AS fold FROM orders")
def _(t: Tables):
    return sampling.folds(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey").select("o_orderkey", "fold")


def _fresh(t: Tables, name: str) -> str:
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("S6_training_load", "SELECT p_name AS descr, p_type AS cls, true AS dated FROM part UNION ALL SELECT p_name, p_type, true FROM part")
def _(t: Tables):
    csv, table = _fresh(t, "training"), _fresh(t, "table")
    io.write_csv(t.part.select(F.col("p_name").alias("descr"), F.col("p_type").alias("cls")), csv)
    for _ in range(2):
        io.load_training(t.spark, csv, "descr string, cls string", table)
    return t.spark.read.parquet(table).select("descr", "cls", F.col("create_dt").isNotNull().alias("dated"))


@query("S7_landing_batch", "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'")
def _(t: Tables):
    csv, table = _fresh(t, "landing"), _fresh(t, "table")
    io.write_csv(t.customer.select("c_custkey", "c_name", "c_mktsegment"), csv)
    io.load_workbook(t.spark, csv, "c_custkey long, c_name string, c_mktsegment string", "BUILDING", "c_mktsegment", table)
    return t.spark.read.parquet(table)


@query("S11_sentences", """
SELECT array_to_string(w, ' ') AS tokens, count(*) AS n FROM (SELECT list_filter(regexp_split_to_array(lower(regexp_replace(s, '[^a-zA-Z]', ' ', 'g')), '\\s+'), lambda x: x <> '') AS w
  FROM (SELECT unnest(regexp_split_to_array(text, '[.!?\\n]+')) AS s FROM benchmark)) WHERE len(w) >= 3 GROUP BY 1""")
def _(t: Tables):
    folder = _fresh(t, "sentences")
    t.benchmark.select(F.pmod("item_id", F.lit(5)).alias("part"), "text").write.partitionBy("part").text(folder)
    tokens = io.read_sentences(t.spark, folder)
    return tokens.groupBy(F.array_join("tokens", " ").alias("tokens")).agg(F.count("*").alias("n"))


@query("S14_newest_models", "SELECT '20200103000000' AS newest, 2 AS folders, true AS complete, false AS with_more, count(*) AS n_known FROM part")
def _(t: Tables):
    """Of three sets of models two stay; the newest is loaded and has all training texts."""
    folders = io.ModelFolders(t.spark, _fresh(t, "models"), keep=2)
    model = classify.TextModel(t.part, "p_name", "p_type", "p_partkey", "jaro")
    for day in (1, 2, 3):
        folders.save({"Jaro": model}, f"2020010{day}000000")
    newest = folders.newest(["Jaro"])
    known = folders.load(newest, classify.MODELS)["Jaro"].args[0]
    facts = [F.lit(newest.rsplit("/", 1)[1]).alias("newest"), F.lit(len(folders.folders())).alias("folders"), F.lit(folders.complete(newest, ["Jaro"])).alias("complete"), F.lit(folders.complete(newest, ["Jaro", "DeepNN"])).alias("with_more")]
    return known.agg(F.count("*").alias("n_known")).select(*facts, "n_known")


@query("G1_tables_there", "SELECT 'nation' AS name, true AS there UNION ALL SELECT 'nations', false")
def _(t: Tables):
    found = [(n, pipeline.table_exists(t.spark, f"{t.folder}/{n}.parquet")) for n in ("nation", "nations")]
    return t.spark.createDataFrame(found, "name string, there boolean")


@query("G3_something_new", """
WITH c AS (SELECT unnest([true, true, false]) AS models, unnest(['A', 'X', 'X']) AS status)
SELECT models, status, NOT models OR EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = status) AS something_new FROM c
UNION ALL SELECT true, 'O', EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'O')""")
def _(t: Tables):
    cases = [(True, "A"), (True, "X"), (False, "X"), (True, "O")]
    none = t.customer.where("c_custkey < 0")
    found = [(m, s, pipeline.something_new(m, t.orders.where(F.col("o_orderstatus") == s), none)) for m, s in cases]
    return t.spark.createDataFrame(found, "models boolean, status string, something_new boolean")


@query("N13_incremental", """
SELECT p_partkey, CASE WHEN p_size < 40 THEN 'No Review Necessary' ELSE 'Pending' END AS rev_stat, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS batch FROM part""")
def _(t: Tables):
    """Two arrivals of new lines; those that were settled in the first are not classified again."""
    source, to, mark = (_fresh(t, n) for n in ("arrivals", "classified", "progress"))
    lines = t.part.select("p_partkey", "p_size")
    judge = lambda d: d.select("p_partkey", F.when(F.col("p_size") < 40, "No Review Necessary").otherwise("Pending").alias("rev_stat"))
    for first in (True, False):
        arrived = lines.where("p_partkey % 2 = 1") if first else lines.where("p_partkey % 2 = 0 or p_size < 40")
        arrived.write.mode("append").parquet(source)
        incremental.classify_new(t.spark, source, "p_partkey long, p_size int", judge, to, mark, ["p_partkey"], "rev_stat").awaitTermination()
    return t.spark.read.parquet(to).select("p_partkey", "rev_stat", "batch")
