"""Lines with codes, units and amounts; votes and their measures; over whole tables."""

from __future__ import annotations

from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import functions as F

from lexispark.operators import metrics, voting
from lexispark.operators import structured as st
from lexispark.plans.registry import Tables, query

_BRANDS = [f"Brand#{i}" for i in range(1, 26)]


def lines(t: Tables):
    """Lines with description, group, code, units and amount."""
    line, part = t.lineitem, t.part
    return line.join(part, line["l_partkey"] == part["p_partkey"]).select(
        "l_orderkey", "l_linenumber", F.col("p_name").alias("descrip"), F.col("p_brand").alias("brand"), F.col("p_type").alias("cls"),
        F.pmod("l_partkey", F.lit(1000)).alias("rev_code"), F.col("l_quantity").alias("units"), F.col("l_extendedprice").alias("billed"),
    )


_L = "WITH l AS (SELECT l_orderkey, l_linenumber, p_name AS descrip, p_brand AS brand, p_type AS cls, l_partkey % 1000 AS rev_code, l_quantity AS units, l_extendedprice AS billed FROM lineitem JOIN part ON l_partkey = p_partkey) "


@query("J15_lines_with_labels", _L + "SELECT l_orderkey, l_linenumber, descrip, cls FROM l ORDER BY descrip")
def _(t: Tables):
    return lines(t).select("l_orderkey", "l_linenumber", "descrip", "cls").orderBy("descrip")


@query("J16_lines_left_join", "SELECT s_suppkey, coalesce(l_orderkey, -1) AS l_orderkey, coalesce(l_linenumber, 0) AS l_linenumber FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_quantity > 45")
def _(t: Tables):
    s, line = t.supplier, t.lineitem.where("l_quantity > 45")
    return s.join(line, s["s_suppkey"] == line["l_suppkey"], "left").select("s_suppkey", F.coalesce("l_orderkey", F.lit(-1)).alias("l_orderkey"), F.coalesce("l_linenumber", F.lit(0)).alias("l_linenumber"))


@query("J17_V8_actual_and_predicted", "SELECT doc_id, quality, lang, CAST((CASE WHEN quality = 1 THEN 'en' ELSE 'de' END) = lang AS INTEGER) AS match FROM labels JOIN documents USING (doc_id)")
def _(t: Tables):
    said = t.labels.select("doc_id", "quality", F.when(F.col("quality") == 1, "en").otherwise("de").alias("vote"))
    return voting.compared(said, t.documents.select("doc_id", "lang"), "doc_id", "lang", "vote").select("doc_id", "quality", "lang", "match")


@query("J18_join_dominance", _L + """, c AS (SELECT rev_code, cls, count(*) AS n, row_number() OVER (PARTITION BY rev_code ORDER BY count(*) DESC, cls) AS r FROM l GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, c.cls AS dominant_cc1 FROM l LEFT JOIN c ON c.rev_code = l.rev_code AND r = 1""")
def _(t: Tables):
    d = lines(t)
    return st.with_dominance(d, st.dominance(d, "rev_code", "cls"), "rev_code").select("l_orderkey", "l_linenumber", "dominant_cc1")


@query("J19_expand_split", "SELECT l_orderkey, l_linenumber, p_type FROM lineitem JOIN part ON p_partkey = l_partkey JOIN (SELECT DISTINCT p_name AS u FROM part WHERE p_size > 25) ON u = p_name")
def _(t: Tables):
    unique = t.part.where("p_size > 25").select(F.col("p_name").alias("descrip")).distinct()
    return lines(t).join(unique, "descrip").select("l_orderkey", "l_linenumber", F.col("cls").alias("p_type"))


@query("F9_valid_lines", _L + "SELECT l_orderkey, l_linenumber FROM l WHERE billed >= 0 AND units > 0 AND rev_code > 99 AND rev_code <= 999")
def _(t: Tables):
    return st.valid_lines(lines(t), "billed", "units", "rev_code").select("l_orderkey", "l_linenumber")


@query("F10_unit_price", "SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_tax > 0.02 THEN l_extendedprice END, -100) / coalesce(CASE WHEN l_linenumber < 4 THEN l_quantity END, -100) AS norm_billed_amount FROM lineitem")
def _(t: Tables):
    billed, units = F.when(F.col("l_tax") > 0.02, F.col("l_extendedprice")), F.when(F.col("l_linenumber") < 4, F.col("l_quantity"))
    return t.lineitem.select("l_orderkey", "l_linenumber", st.unit_price(billed, units).alias("norm_billed_amount"))


@query("F11_rare_as_others", "SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_brand) < 80 THEN 'Others' ELSE p_brand END AS p_brand FROM part")
def _(t: Tables):
    return st.rare_as_others(t.part.select("p_partkey", "p_brand"), "p_brand", 80)


def _case(value: str) -> str:
    edges = st.AMOUNT_EDGES
    bins = " ".join(f"WHEN {value} <= {b} THEN '({a}, {b}]'" for a, b in zip(edges, edges[1:]))
    return f"CASE WHEN {value} <= {edges[0]} THEN NULL {bins} WHEN {value} > {edges[-1]} THEN '({edges[-1]}, max]' END"


@query("M9_bins", f"SELECT l_orderkey, l_linenumber, {_case('(l_extendedprice / 5 - 200)')} AS amount_bin, CASE WHEN l_quantity - 1 <= 0 THEN NULL WHEN l_quantity - 1 <= 1 THEN 'Units <= 1' ELSE 'Units > 1' END AS units_bin FROM lineitem")
def _(t: Tables):
    amount = F.col("l_extendedprice") / 5 - 200
    return t.lineitem.select("l_orderkey", "l_linenumber", st.interval(amount, st.AMOUNT_EDGES).alias("amount_bin"), st.units_bin(F.col("l_quantity") - 1).alias("units_bin"))


_GROUPS = "CASE " + " ".join(f"WHEN rev_code BETWEEN {a} AND {b} THEN '{n}'" for a, b, n in reversed(st.REVENUE_GROUPS)) + " ELSE 'Others' END"


@query("M10_revenue_groups", _L + f"SELECT l_orderkey, l_linenumber, {_GROUPS} AS rev_code_name FROM l")
def _(t: Tables):
    return lines(t).select("l_orderkey", "l_linenumber", st.revenue_group(F.col("rev_code")).alias("rev_code_name"))


@query("A7_grouped_medians", _L + "SELECT descrip, brand, round(median(units), 6) AS units, round(median(billed), 6) AS billed, arg_min(cls, struct_pack(a := l_orderkey, b := l_linenumber, c := cls)) AS cls FROM l GROUP BY 1, 2")
def _(t: Tables):
    return st.grouped_medians(lines(t), ["descrip", "brand"], ["units", "billed"], ["cls"], ["l_orderkey", "l_linenumber", "cls"])


@query("A8_group_sizes", _L + f"SELECT {_GROUPS} AS rev_code_name, cls, count(*) AS n FROM l GROUP BY 1, 2")
def _(t: Tables):
    return lines(t).groupBy(st.revenue_group(F.col("rev_code")).alias("rev_code_name"), "cls").agg(F.count("*").alias("n"))


@query("A9_distinct_pivot", "SELECT p_type, " + ", ".join(f"count(DISTINCT CASE WHEN p_brand = '{b}' THEN p_name END) AS \"{b}\"" for b in _BRANDS) + " FROM part GROUP BY 1")
def _(t: Tables):
    return st.distinct_pivot(t.part, "p_type", "p_brand", "p_name", _BRANDS)


@query("A10_dominance", _L + """, c AS (SELECT rev_code, cls, count(*) AS n, row_number() OVER (PARTITION BY rev_code ORDER BY count(*) DESC, cls) AS r, sum(count(*)) OVER (PARTITION BY rev_code) AS total FROM l GROUP BY 1, 2)
SELECT rev_code, max(CASE WHEN r = 1 THEN cls END) AS dominant_cc1, coalesce(max(CASE WHEN r = 2 THEN cls END), '') AS dominant_cc2, CAST(max(total) AS BIGINT) AS n_descriptions,
  max(CASE WHEN r = 1 THEN round(100.0::DOUBLE * n / total, 6) END) AS pct1, coalesce(max(CASE WHEN r = 2 THEN round(100.0::DOUBLE * n / total, 6) END), 0) AS pct2 FROM c GROUP BY 1""")
def _(t: Tables):
    return st.dominance(lines(t), "rev_code", "cls")


@query("A11_crosstab", "SELECT CASE WHEN grouping(l_returnflag) = 1 THEN 'Total' ELSE l_returnflag END AS l_returnflag, count(*) FILTER (l_linestatus = 'O') AS \"O\", count(*) FILTER (l_linestatus = 'F') AS \"F\", count(*) AS total FROM lineitem GROUP BY ROLLUP (l_returnflag)")
def _(t: Tables):
    return st.crosstab(t.lineitem, "l_returnflag", "l_linestatus", ["O", "F"])


@query("A12_weekend_hours", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, " + ", ".join(f"round(sum(CASE WHEN hour(ts) = {h} THEN value ELSE 0.0::DOUBLE END), 4) AS h{h:02d}" for h in range(24)) + " FROM events WHERE dayofweek(ts) IN (0, 6) GROUP BY 1")
def _(t: Tables):
    return st.weekend_hours(t.events, "ts", "value").withColumn("day", F.col("day").cast("string"))


def votes(t: Tables):
    """Four classifiers' votes for each row, from events."""
    names = F.array(*map(F.lit, ("Jaro", "DLevenshtein", "Logistic_OvR", "DeepNN")))
    idx = F.pmod("event_id", F.lit(4)).cast("int")
    return t.events.select(F.floor(F.col("event_id") / 4).cast("long").alias("row_id"), idx.alias("clf_idx"), F.get(names, idx).alias("clf"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("prediction"), F.least(F.lit(1.0), F.col("value") / 100).alias("prob"))


_V = "WITH v AS (SELECT event_id // 4 AS row_id, CAST(event_id % 4 AS INTEGER) AS clf_idx, ['Jaro', 'DLevenshtein', 'Logistic_OvR', 'DeepNN'][event_id % 4 + 1] AS clf, CASE WHEN event_type <> 'error' THEN event_type END AS prediction, least(1.0, value / 100) AS prob FROM events), g AS (SELECT row_id, prediction, count(*) AS n, avg(prob) AS m, sum(prob) AS s, string_agg(clf, ', ' ORDER BY clf_idx) AS names FROM v WHERE prediction IS NOT NULL GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY n DESC, round(m, 9) DESC, prediction) AS r FROM g) "


@query("V1_majority_vote", _V + "SELECT a.row_id, coalesce(b.prediction, '') AS vote, coalesce(names, '') AS algorithms, coalesce(n, 0) AS n_agree FROM (SELECT DISTINCT row_id FROM v) a LEFT JOIN b ON b.row_id = a.row_id AND r = 1")
def _(t: Tables):
    return voting.majority(votes(t)).select("row_id", "vote", "algorithms", "n_agree")


@query("V2_most_probable", _V + "SELECT row_id, prediction, clf FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY prob DESC, clf_idx) AS k FROM v) WHERE k = 1")
def _(t: Tables):
    return voting.most_probable(votes(t)).select("row_id", "prediction", "clf")


@query("V3_confidence", _V + "SELECT a.row_id, round(coalesce(s, 0) / CASE WHEN n = 3 THEN 3.0 ELSE 4.0 END, 6) AS confidence FROM (SELECT DISTINCT row_id FROM v) a LEFT JOIN b ON b.row_id = a.row_id AND r = 1")
def _(t: Tables):
    return voting.majority(votes(t)).select("row_id", F.round(voting.confidence(F.col("n_agree"), F.col("sum_prob")), 6).alias("confidence"))


@query("V4_mean_confidence", _V + "SELECT a.row_id, round(coalesce(s, 0) / a.k, 6) AS mean_confidence FROM (SELECT row_id, count(*) AS k FROM v GROUP BY 1) a LEFT JOIN b ON b.row_id = a.row_id AND r = 1")
def _(t: Tables):
    v = votes(t)
    return voting.mean_confidence(v, voting.majority(v)).select("row_id", F.round("mean_confidence", 6).alias("mean_confidence"))


def _bands() -> str:
    return "CASE " + " ".join(f"WHEN clf = '{c}' AND prob >= {a} AND prob < {b} THEN {s}" for c, parts in voting.BANDS.items() for a, b, s in parts) + " ELSE prob END"


@query("V5_band_boost", _V + f"SELECT row_id, clf, {_bands()} AS prob FROM v")
def _(t: Tables):
    return votes(t).select("row_id", "clf", voting.band_boosted(F.col("clf"), F.col("prob")).alias("prob"))


@query("V6_structured_override", _L + """, c AS (SELECT rev_code, cls, row_number() OVER (PARTITION BY rev_code ORDER BY count(*) DESC, cls) AS r FROM l GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, CASE WHEN l.cls = c.cls AND units / 50 > 0.6 THEN 0.95 ELSE units / 50 END AS confidence FROM l LEFT JOIN c ON c.rev_code = l.rev_code AND r = 1""")
def _(t: Tables):
    d = lines(t)
    d = st.with_dominance(d, st.dominance(d, "rev_code", "cls"), "rev_code")
    return d.select("l_orderkey", "l_linenumber", st.structured_override(F.col("cls"), F.col("dominant_cc1"), F.col("units") / 50).alias("confidence"))


_W = _V + ", w AS (SELECT row_id, max(CASE WHEN clf_idx = 0 THEN prediction END) AS j, max(CASE WHEN clf_idx = 2 THEN prediction END) AS l, max(CASE WHEN clf_idx = 3 THEN prediction END) AS d, max(CASE WHEN clf_idx = 1 THEN prediction END) AS x FROM v GROUP BY 1), k AS (SELECT row_id, CASE WHEN d = j AND l <> d THEN 'logistic disagree' WHEN l = d AND l <> j THEN 'jaro disagree' WHEN l = j AND l <> d THEN 'deepnn disagree' WHEN j <> l AND j <> d THEN 'all disagree' WHEN j = l AND l = d THEN 'all agree' ELSE 'NA' END AS kind, CAST(coalesce(x = l, false) AS INTEGER) AS match FROM w) "


def _kinds(t: Tables):
    w = voting.wide(votes(t), ["Jaro", "DLevenshtein", "Logistic_OvR", "DeepNN"])
    of = lambda n: F.col(f"Predicted_Class_{n}")
    kind = voting.agreement(of("Jaro"), of("Logistic_OvR"), of("DeepNN"))
    return w.select("row_id", kind.alias("kind"), F.coalesce(of("DLevenshtein") == of("Logistic_OvR"), F.lit(False)).cast("int").alias("match"))


@query("V7_vote_kinds", _W + "SELECT row_id, kind FROM k")
def _(t: Tables):
    return _kinds(t).select("row_id", "kind")


@query("A13_voting_breakdown", _W + "SELECT kind, count(*) AS total, CAST(sum(match) AS BIGINT) AS accurate, CAST(sum(1 - match) AS BIGINT) AS misclassified FROM k GROUP BY 1")
def _(t: Tables):
    return metrics.voting_breakdown(_kinds(t), "kind", "match")


@query("F13_degenerate_classifiers", _V + "SELECT clf, count(DISTINCT prediction) AS n_classes, count(*) FILTER (prob IS NULL) AS n_null, count(DISTINCT prediction) > 1 AND count(*) FILTER (prob IS NULL) = 0 AS keep FROM v GROUP BY 1")
def _(t: Tables):
    return metrics.degenerate(votes(t))


_R = "WITH a AS (SELECT label, sum(s) AS support, sum(p) AS said, sum(h) AS hit FROM (SELECT quality AS label, 1 AS s, 0 AS p, CAST(quality = toxic AS INTEGER) AS h FROM labels UNION ALL SELECT toxic, 0, 1, 0 FROM labels) GROUP BY 1), r AS (SELECT label, CASE WHEN said > 0 THEN round(hit / said, 6) ELSE 0 END AS precision, CASE WHEN support > 0 THEN round(hit / support, 6) ELSE 0 END AS recall, CAST(support AS BIGINT) AS support FROM a) "


@query("A15_class_report", _R + "SELECT * FROM r")
def _(t: Tables):
    return metrics.class_report(t.labels, "quality", "toxic")


@query("A14_accuracies", _R + "SELECT round(100 * sum(recall * support) / sum(support), 3) AS accuracy, round(100 * sum(precision * support) / sum(support), 3) AS precision, round(100 * sum(recall * support) / sum(support), 3) AS recall FROM r")
def _(t: Tables):
    return metrics.accuracies(t.labels, "quality", "toxic")


@query("A16_confusion", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2")
def _(t: Tables):
    return metrics.confusion(t.labels, "quality", "toxic")


@query("A17_confidence_buckets", """
WITH b AS (SELECT CAST(least(9, greatest(0, floor(value / 50))) AS INTEGER) AS bucket, count(*) AS n, CAST(sum(CAST(event_type = 'click' AS INTEGER)) AS BIGINT) AS "right" FROM (SELECT value * 5 AS value, event_type FROM events) GROUP BY 1)
SELECT bucket, n, "right", CAST(sum(n) OVER (ORDER BY bucket DESC) AS BIGINT) AS n_from_top, CAST(sum("right") OVER (ORDER BY bucket DESC) AS BIGINT) AS right_from_top FROM b""")
def _(t: Tables):
    e = t.events.select((F.col("value") / 100).alias("c"), (F.col("event_type") == "click").cast("int").alias("m"))
    return metrics.confidence_buckets(e, "c", "m")


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("A18_spreads", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(stddev_samp({c}), 4) AS std, round(sum({c}), 2) AS total FROM lineitem" for c in _NUM))
def _(t: Tables):
    return metrics.spreads(t.lineitem, _NUM)


@query("A19_correlations", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 4) AS r FROM lineitem" for i, a in enumerate(_NUM) for b in _NUM[i + 1 :]))
def _(t: Tables):
    return metrics.correlations(t.lineitem, _NUM)


@query("A19_sparse_correlations", """
WITH w AS (SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: length(x) >= 3)) AS word FROM benchmark),
n AS (SELECT count(*) AS n FROM benchmark), c AS (SELECT word, count(*)::DOUBLE AS k FROM w GROUP BY 1),
m AS (SELECT a.word AS a, b.word AS b, count(*)::DOUBLE AS k FROM w a JOIN w b ON a.item_id = b.item_id AND a.word < b.word GROUP BY 1, 2)
SELECT a, b, round((m.k / n - x.k / n * y.k / n) / sqrt((x.k / n - (x.k / n) ** 2) * (y.k / n - (y.k / n) ** 2)), 4) AS r FROM m JOIN c x ON x.word = a JOIN c y ON y.word = b, n
WHERE x.k < n AND y.k < n AND (m.k / n - x.k / n * y.k / n) / sqrt((x.k / n - (x.k / n) ** 2) * (y.k / n - (y.k / n) ** 2)) >= 0.9""")
def _(t: Tables):
    """Words of the benchmark's items that go together, over all of them as features."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w) >= 3))
    items = t.benchmark.select(words.alias("words"))
    names = [r.word for r in items.select(F.explode("words").alias("word")).distinct().orderBy("word").collect()]
    bag = CountVectorizerModel.from_vocabulary(names, inputCol="words", outputCol="v", binary=True)
    found = metrics.sparse_correlations(bag.transform(items), "v", 0.9).where("r > 0")
    table = t.spark.createDataFrame([(i, w) for i, w in enumerate(names)], "i int, w string")
    found = found.join(table.select(F.col("i").alias("a"), F.col("w").alias("wa")), "a").join(table.select(F.col("i").alias("b"), F.col("w").alias("wb")), "b")
    return found.select(F.col("wa").alias("a"), F.col("wb").alias("b"), F.round("r", 4).alias("r"))
