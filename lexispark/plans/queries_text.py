"""Text functions and similarity over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispark.functions import corrections, similarity, stems, text
from lexispark.operators import fuzzy
from lexispark.plans.registry import Tables, query
from lexispark.sources import io

T1 = "regexp_replace(regexp_replace({0}, '[^A-Za-z0-9+%.>/&]', ' ', 'g'), ' {{2,}}', ' ', 'g')"
_STOP = text.stop_words()
_IN = ", ".join("'" + w.replace("'", "''") + "'" for w in _STOP)


@query("T1_charset_clean", f"SELECT doc_id, {T1.format('text')} AS cleaned FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", text.charset_clean("text").alias("cleaned"))


@query("T2_strip_lead", "SELECT p_partkey, regexp_replace(CASE p_brand WHEN 'Brand#2' THEN 'HB ' WHEN 'Brand#4' THEN 'HC ' ELSE 'HCG ' END || p_name, '^(HB|HC) ', '') AS descr FROM part")
def _(t: Tables):
    lead = F.when(F.col("p_brand") == "Brand#2", "HB ").when(F.col("p_brand") == "Brand#4", "HC ").otherwise("HCG ")
    return t.part.select("p_partkey", text.strip_lead(F.concat(lead, "p_name")).alias("descr"))


_T3 = f"""list_filter(regexp_split_to_array(lower({{0}}), '\\s+'), lambda w: w <> '' AND w NOT IN ({_IN}))"""


@query("T3_sentence_tokens", f"""
SELECT doc_id, array_to_string(CASE WHEN starts_with(text, '==') THEN [] ELSE flatten(list_transform({_T3.format('text')},
  lambda w: CASE WHEN contains(w, '/') AND NOT regexp_matches(w, '[0-9]') THEN list_filter(string_split(w, '/'), lambda p: p <> '') ELSE [w] END)) END, ' ') AS tokens FROM documents""")
def _(t: Tables):
    return t.documents.select("doc_id", F.array_join(text.sentence_tokens("text", _STOP), " ").alias("tokens"))


@query("T4_normalized", f"""
SELECT item_id, array_to_string(flatten(list_transform({_T3.format('text')},
  lambda w: CASE WHEN contains(w, '/') AND NOT regexp_matches(w, '[0-9]') THEN list_filter(string_split(w, '/'), lambda p: p <> '') ELSE [w] END)), ' ') AS norm, lower(text) AS plain FROM benchmark""")
def _(t: Tables):
    return t.benchmark.select("item_id", text.normalized("text", "text", _STOP).alias("norm"), text.normalized(None, "text").alias("plain"))


@query("T5_word_grams", """
WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM benchmark)
SELECT item_id, array_to_string(flatten(list_transform(range(2, 7), lambda n: list_transform(range(1, greatest(len(ws) - n + 2, 1)), lambda i: array_to_string(ws[i:i + n - 1], ' ')))), '|') AS grams FROM w""")
def _(t: Tables):
    return t.benchmark.select("item_id", F.array_join(text.word_grams("text"), "|").alias("grams"))


_GRAMS = ("red widget", "small ring", "hot gear economy")


@query("T6_join_expansions", """
SELECT p_partkey, replace(replace(lower(p_name || ' ' || p_type), 'red widget', 'red_widget'), 'small ring', 'small_ring') AS joined FROM (
  SELECT p_partkey, p_name, p_type FROM part) WHERE NOT starts_with(lower(p_name || ' ' || p_type), 'hot gear economy')
UNION ALL SELECT p_partkey, replace(lower(p_name || ' ' || p_type), 'hot gear economy', 'hot_gear_economy') FROM part WHERE starts_with(lower(p_name || ' ' || p_type), 'hot gear economy')""")
def _(t: Tables):
    return t.part.select("p_partkey", corrections.join_expansions(F.lower(F.concat_ws(" ", "p_name", "p_type")), _GRAMS).alias("joined"))


# The original `sol <second word> <brand> iv` was normalised with `sol` as solid and `iv` as a known expansion, and
# corrected to the part's name and `inner valve`, without the brand.
@query("T7_T8_mined_corrections", """
WITH p AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, lower(replace(p_brand, '#', '')) AS brand FROM part)
SELECT p_partkey, 'iv:inner_valve:' || brand AS abbreviations, 'sol:' || a || ':' || b || ';' || brand || ':NoChange:iv' AS spellings FROM p""")
def _(t: Tables):
    a, b, brand = F.split("p_name", " ")[0], F.split("p_name", " ")[1], F.lower(F.regexp_replace("p_brand", "#", ""))
    d = t.part.select("p_partkey", F.concat_ws(" ", F.lit("sol"), b, brand, F.lit("iv")).alias("original"), F.concat_ws(" ", F.lit("solid"), b, brand, F.lit("intra_venous")).alias("norm"), F.lit("sol:solid||iv:intra_venous").alias("changes"), F.concat_ws(" ", a, b, F.lit("inner valve")).alias("corrected"))
    return corrections.mined_changes(d, {"intra_venous": ["iv"]}).select("p_partkey", "abbreviations", "spellings")


# The same, called from SQL, with a part whose corrected text is missing.
@query("N14_mined_in_sql", """
WITH p AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS a, lower(replace(p_brand, '#', '')) AS brand, p_partkey % 10 = 0 AS lacks FROM part)
SELECT p_partkey, CASE WHEN lacks THEN '' ELSE 'iv:inner_valve:' || brand END AS abbreviations, CASE WHEN lacks THEN '' ELSE 'sol:' || a || ':' || split_part(p_name, ' ', 2) || ';' || brand || ':NoChange:iv' END AS spellings
FROM p JOIN part USING (p_partkey)""")
def _(t: Tables):
    similarity.register(t.spark)
    return t.spark.sql("""
        SELECT p_partkey, m.abbreviations, m.spellings FROM (
          SELECT *, split(p_name, ' ')[0] AS a, split(p_name, ' ')[1] AS b, lower(replace(p_brand, '#', '')) AS brand FROM {part}) p,
        LATERAL mine_corrections(concat_ws(' ', 'sol', b, brand, 'iv'), concat_ws(' ', 'solid', b, brand, 'intra_venous'), 'sol:solid||iv:intra_venous',
          CASE WHEN p_partkey % 10 <> 0 THEN concat_ws(' ', a, b, 'inner valve') END, map('intra_venous', array('iv'))) m""", part=t.part)


# Of the words of norm: none that are numbers; the important ones where there are more than four; split on slashes
# unless there is a digit; `economy` as `eco` where the original has that.
@query("T9_feature_tokens", """
WITH d AS (SELECT p_partkey, p_name || CASE WHEN p_size % 2 = 0 THEN ' eco' ELSE '' END AS original,
    list_filter(string_split(lower(p_name || ' ' || p_type || '/kit ' || p_size || ' ' || CASE WHEN p_size % 3 = 0 THEN 'economy ' || p_name || ' extra ' ELSE '' END || p_brand || '/x'), ' '), lambda w: NOT regexp_matches(w, '^[0-9]+$')) AS ws FROM part),
i AS (SELECT *, list_filter(ws, lambda w: w IN ('red', 'economy', 'widget', 'ring')) AS kept FROM d),
w AS (SELECT p_partkey, original, CASE WHEN len(ws) > 4 AND len(kept) > 0 THEN kept ELSE ws END AS ws FROM i),
o AS (SELECT p_partkey, original, list_filter(ws, lambda x, n: list_position(ws, x) = n) AS ws FROM w),
f AS (SELECT p_partkey, list_transform(flatten(list_transform(ws, lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN [w] ELSE string_split(w, '/') END)),
    lambda w: CASE WHEN w = 'economy' AND list_contains(string_split(lower(original), ' '), 'eco') THEN 'eco' ELSE w END) AS ws FROM o)
SELECT p_partkey, coalesce(ws[1][:6], '') AS feature_1, coalesce(ws[2][:6], '') AS feature_2, coalesce(ws[3][:6], '') AS feature_3, coalesce(ws[4][:6], '') AS feature_4 FROM f""")
def _(t: Tables):
    more = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("economy "), "p_name", F.lit(" extra "))).otherwise("")
    d = t.part.withColumn("norm", F.lower(F.concat("p_name", F.lit(" "), "p_type", F.lit("/kit "), "p_size", F.lit(" "), more, "p_brand", F.lit("/x"))))
    d = d.withColumn("original", F.concat("p_name", F.when(F.col("p_size") % 2 == 0, " eco").otherwise("")))
    short = F.create_map(F.lit("economy"), F.array(F.lit("ECO")))
    f = text.feature_tokens("norm", "original", short, ("red", "economy", "widget", "ring"), width=6)
    return d.select("p_partkey", *(F.get(f, F.lit(i)).alias(f"feature_{i + 1}") for i in range(4)))


@query("T10_change_map", "SELECT p_partkey, split_part(p_name, ' ', 1) AS ring_from, p_type AS type_from FROM part")
def _(t: Tables):
    codec = F.concat(F.split("p_name", " ")[0], F.lit(":one||"), F.col("p_type"), F.lit(":two"))
    m = text.change_map(codec)
    return t.part.select("p_partkey", F.element_at(m, "one").alias("ring_from"), F.element_at(m, "two").alias("type_from"))


@query("T11_change_rows", "SELECT p_partkey, split_part(p_name, ' ', 1) AS word, split_part(p_name, ' ', 2) AS match, p_type AS surrounding_word FROM part")
def _(t: Tables):
    said = F.concat(F.concat_ws(":", F.split("p_name", " ")[0], F.split("p_name", " ")[1], "p_type"), F.lit(";x:NoChange:"))
    return corrections.change_rows(t.part.select("p_partkey", said.alias("c")), "c", "p_partkey")


@query("T12_recoded", "SELECT doc_id, translate(regexp_replace(text, '[^\\x00-\\xFF]', '?', 'g'), '\"' || chr(9), '') AS recoded FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", text.latin1_recoded(F.encode("text", "ISO-8859-1")).alias("recoded"))


@query("T13_document_clean", r"""
WITH a AS (SELECT doc_id, regexp_replace(text, '[^\x00-\x7F]+', '', 'g') AS s FROM documents),
b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(s, 'https?://[^ \t\n\r]+', ' ', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+', ' ', 'g'), '[+]?[0-9][0-9() .-]{6,}[0-9]', ' ', 'g') AS s FROM a)
SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(s, '[0-9]+', ' ', 'g'), '[^A-Za-z ]', ' ', 'g'), ' {2,}', ' ', 'g')) AS cleaned FROM b""")
def _(t: Tables):
    return t.documents.select("doc_id", text.document_clean("text").alias("cleaned"))


# Case notes of 0 to 4 of the phrases, which stand in every order of length.
_NOTES = ("Weather related: YES", "weather-related n", "weather related", "Additional involved parties: none", "additional involved parties")


@query("T13_phrases", f"""
WITH n AS (SELECT p_partkey, CASE p_size % 5 {' '.join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_NOTES))} END || ', of ' || p_name || ' 12' AS note FROM part)
SELECT p_partkey, CASE split_part(note, ', ', 1) WHEN 'Weather related: YES' THEN '. This claim is related to weather.' WHEN 'additional involved parties' THEN '.' ELSE '' END || ' of ' || p_name AS cleaned FROM n JOIN part USING (p_partkey)""")
def _(t: Tables):
    note = F.element_at(F.array(*map(F.lit, _NOTES)), (F.col("p_size") % 5 + 1).cast("int"))
    return t.part.select("p_partkey", text.document_clean(F.concat(note, F.lit(", of "), "p_name", F.lit(" 12")), text.PHRASES).alias("cleaned"))


@query("T14_corpus_tokens", "SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(lower(regexp_replace(text, '[^a-zA-Z]', ' ', 'g')), '\\s+'), lambda w: w <> ''), ' ') AS tokens FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", F.array_join(text.corpus_tokens("text"), " ").alias("tokens"))


@query("T15_correction_clean", "SELECT doc_id, regexp_replace(replace(text, ',', ' '), ' {2,}', ' ', 'g') AS cleaned FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", text.correction_clean("text").alias("cleaned"))


@query("F1_line_clean", "SELECT doc_id, trim(translate(text, '\",' || chr(13) || chr(10), '    ')) AS cleaned FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", text.line_clean("text").alias("cleaned"))


@query("S15_reverse_mapping", "SELECT replace(trim(lower(p_name)), ' ', '_') AS expansion, p_brand AS abbr FROM part")
def _(t: Tables):
    return io.reverse_mapping(t.part, "p_name", "p_brand")


_A, _B = "p_name || ' ' || p_type", "p_name || ' ' || p_brand"
_M = "regexp_replace({0}, '[^A-Za-z0-9+%.>/&]', '', 'g')"


# The second text of D1 and D2: two signs swapped, reversed, in upper case, with signs between, longer, or empty.
_OTHER = "CASE p_size % 6 WHEN 0 THEN p_name[2:2] || p_name[1:1] || p_name[3:] WHEN 1 THEN reverse(p_name) WHEN 2 THEN upper(p_name) WHEN 3 THEN replace(p_name, ' ', '-#-') WHEN 4 THEN p_name || p_brand ELSE '' END"
_N, _O = _M.format("p_name"), _M.format(f"({_OTHER})")


def _others():
    name = F.col("p_name")
    made = F.when(F.col("p_size") % 6 == 0, F.concat(F.substring(name, 2, 1), F.substring(name, 1, 1), F.substring(name, 3, 99))).when(F.col("p_size") % 6 == 1, F.reverse(name))
    return made.when(F.col("p_size") % 6 == 2, F.upper(name)).when(F.col("p_size") % 6 == 3, F.regexp_replace(name, " ", "-#-")).when(F.col("p_size") % 6 == 4, F.concat("p_name", "p_brand")).otherwise("")


@query("D1_jaro", f"SELECT p_partkey, round(jaro_similarity({_N}, {_O}), 2) AS similarity FROM part")
def _(t: Tables):
    return t.part.select("p_partkey", similarity.jaro_similarity(F.col("p_name"), _others()).alias("similarity"))


@query("D2_damerau_levenshtein", f"SELECT p_partkey, round(1 - damerau_levenshtein({_N}, {_O}) / greatest(length({_N}), length({_O})), 2) AS similarity FROM part")
def _(t: Tables):
    return t.part.select("p_partkey", similarity.damerau_similarity(F.col("p_name"), _others()).alias("similarity"))


def lines(t: Tables):
    """New lines (descr) and known ones (descr, cls, idx), both from part."""
    new = t.part.select(F.concat_ws(" ", "p_name", "p_brand").alias("descr")).distinct()
    known = t.part.groupBy(F.concat_ws(" ", "p_name", "p_type").alias("descr"), F.col("p_type").alias("cls")).agg(F.min("p_partkey").alias("idx"))
    return new, known


_LINES = f"""
WITH n AS (SELECT DISTINCT {_B} AS descr, {_M.format(_B)} AS c FROM part),
k AS (SELECT {_A} AS descr, {_M.format(_A)} AS c, p_type AS cls, min(p_partkey) AS idx FROM part GROUP BY 1, 2, 3),
j AS (SELECT n.descr, k.descr AS k_descr, k.cls, k.idx, round(jaro_similarity(n.c, k.c), 2) AS jaro, round(1 - damerau_levenshtein(n.c, k.c) / greatest(length(n.c), length(k.c)), 2) AS dl FROM n, k)
"""


@query("J12_fuzzy_match", _LINES + """, b AS (SELECT *, row_number() OVER (PARTITION BY descr ORDER BY jaro DESC, idx) AS r FROM j WHERE jaro >= 0.85)
SELECT n.descr, b.cls AS prediction, CASE WHEN b.jaro >= 0.85 AND b.jaro < 0.9 THEN 0.91 ELSE b.jaro END AS score FROM n LEFT JOIN b ON b.descr = n.descr AND b.r = 1""")
def _(t: Tables):
    new, known = lines(t)
    return fuzzy.nearest(new, known, "descr", "cls", "idx", "jaro", 0.85).select("descr", "prediction", fuzzy.boosted(F.col("similarity")).alias("score"))


# The names and brands of parts against the same with one sign changed or gone, each of one class or of two.
_NEAR = f"""
WITH n AS (SELECT DISTINCT {_B} AS descr, {_M.format(_B)} AS c FROM part),
x AS (SELECT DISTINCT p_name, p_brand, p_size % 2 AS odd FROM part),
k AS (SELECT replace(p_name, 'g', CASE WHEN odd = 1 THEN 'q' ELSE '' END) || ' ' || p_brand AS descr, split_part(p_name, ' ', 1 + odd) AS cls FROM x),
j AS (SELECT n.descr, k.cls, round(jaro_similarity(n.c, {_M.format('k.descr')}), 2) AS jaro FROM n, k)
"""


def near_lines(t: Tables):
    """New lines (descr) and known ones (descr, cls) that are much like them."""
    new = t.part.select(F.concat_ws(" ", "p_name", "p_brand").alias("descr")).distinct()
    x = t.part.select("p_name", "p_brand", (F.col("p_size") % 2).alias("odd")).distinct()
    name = F.when(F.col("odd") == 1, F.regexp_replace("p_name", "g", "q")).otherwise(F.regexp_replace("p_name", "g", ""))
    return new, x.select(F.concat_ws(" ", name, "p_brand").alias("descr"), F.element_at(F.split("p_name", " "), F.col("odd") + 1).alias("cls"))


@query("J13_unanimous_match", _NEAR + "SELECT descr, count(*) AS n_matches, count(DISTINCT cls) AS n_classes, round(avg(jaro), 6) AS mean_similarity, CASE WHEN count(DISTINCT cls) = 1 THEN min(cls) END AS prediction FROM j WHERE jaro >= 0.95 GROUP BY 1")
def _(t: Tables):
    new, known = near_lines(t)
    return fuzzy.unanimous(new, known, "descr", "cls", "descr", 0.95).withColumn("mean_similarity", F.round("mean_similarity", 6))


@query("J14_match_counts", _NEAR + "SELECT descr, count(*) AS n_matches, count(DISTINCT cls) AS n_classes, round(avg(jaro), 6) AS mean_similarity FROM j WHERE jaro >= 0.90 GROUP BY 1")
def _(t: Tables):
    new, known = near_lines(t)
    return fuzzy.unanimous(new, known, "descr", "cls", "descr", 0.90).select("descr", "n_matches", "n_classes", F.round("mean_similarity", 6).alias("mean_similarity"))


@query("C1_jaro_nearest", _LINES + "SELECT descr, arg_min(cls, idx) AS prediction, max(jaro) AS similarity FROM (SELECT *, max(jaro) OVER (PARTITION BY descr) AS top FROM j) WHERE jaro = top GROUP BY 1")
def _(t: Tables):
    new, known = lines(t)
    return fuzzy.nearest(new, known, "descr", "cls", "idx", "jaro")


@query("C2_damerau_nearest", _LINES + "SELECT descr, cls AS prediction, dl AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY descr ORDER BY dl DESC, k_descr, idx) AS r FROM j) WHERE r = 1")
def _(t: Tables):
    new, known = lines(t)
    return fuzzy.nearest(new, known, "descr", "cls", "idx", "dl", by_text=True)


# Every rule once more, in another way: the suffix by one expression that takes the longest, its new form from a map.
_STEMS = r"""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(regexp_replace(text, '[^a-zA-Z]', ' ', 'g')), '[a-z]+')) AS word FROM documents),
s0 AS (SELECT word, regexp_replace(regexp_replace(word, '(^|[aeiou])y', '\1Y', 'g'), 'yy', 'yY', 'g') AS x FROM w),
s1 AS (SELECT word, CASE WHEN x LIKE '%sses' OR x LIKE '%ies' THEN left(x, -2) WHEN x LIKE '%s' AND x NOT LIKE '%ss' THEN left(x, -1) ELSE x END AS x FROM s0 WHERE length(word) > 2),
s2 AS (SELECT word, x, CASE WHEN x LIKE '%eed' THEN NULL WHEN regexp_matches(x, '[aeiouy].*ed$') THEN left(x, -2) WHEN regexp_matches(x, '[aeiouy].*ing$') THEN left(x, -3) END AS cut FROM s1),
s3 AS (SELECT word, CASE WHEN x LIKE '%eed' THEN CASE WHEN regexp_matches(x, '^[^aeiouy]*[aeiouy]+[^aeiouy].*eed$') THEN left(x, -1) ELSE x END WHEN cut IS NULL THEN x WHEN regexp_matches(cut, '(at|bl|iz)$') THEN cut || 'e'
  WHEN regexp_matches(cut, '(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx|yY)$') THEN left(cut, -1) WHEN regexp_matches(cut, '^[^aeiouy]+[aeiouy][^aeiouywxY]$') THEN cut || 'e' ELSE cut END AS x FROM s2),
s4 AS (SELECT word, CASE WHEN regexp_matches(x, '[aeiouy].*[yY]$') THEN left(x, -1) || 'i' ELSE x END AS x FROM s3),
t2 AS (SELECT map(string_split('ational tional enci anci izer abli alli entli eli ousli ization ation ator alism iveness fulness ousness aliti iviti biliti', ' '), string_split('ate tion ence ance ize able al ent e ous ize ate ate al ive ful ous al ive ble', ' ')) AS m),
t3 AS (SELECT map(string_split('icate ative alize iciti ical ful ness', ' '), ['ic', '', 'al', 'ic', 'ic', '', '']) AS m),
s5 AS (SELECT word, x, regexp_extract(x, '(ational|tional|enci|anci|izer|abli|alli|entli|eli|ousli|ization|ation|ator|alism|iveness|fulness|ousness|aliti|iviti|biliti)$', 1) AS e FROM s4),
s6 AS (SELECT word, CASE WHEN e <> '' AND regexp_matches(left(x, length(x) - length(e)), '^[^aeiouy]*[aeiouy]+[^aeiouy]') THEN left(x, length(x) - length(e)) || (SELECT m FROM t2)[e] ELSE x END AS x FROM s5),
s7 AS (SELECT word, x, regexp_extract(x, '(icate|ative|alize|iciti|ical|ful|ness)$', 1) AS e FROM s6),
s8 AS (SELECT word, CASE WHEN e <> '' AND regexp_matches(left(x, length(x) - length(e)), '^[^aeiouy]*[aeiouy]+[^aeiouy]') THEN left(x, length(x) - length(e)) || (SELECT m FROM t3)[e] ELSE x END AS x FROM s7),
s9 AS (SELECT word, x, regexp_extract(x, '(al|ance|ence|er|ic|able|ible|ant|ement|ment|ent|ion|ou|ism|ate|iti|ous|ive|ize)$', 1) AS e FROM s8),
s10 AS (SELECT word, CASE WHEN e <> '' AND regexp_matches(left(x, length(x) - length(e)), '^[^aeiouy]*[aeiouy]+[^aeiouy]+[aeiouy]+[^aeiouy]') AND (e <> 'ion' OR regexp_matches(x, '[st]ion$')) THEN left(x, length(x) - length(e)) ELSE x END AS x FROM s9),
s11 AS (SELECT word, CASE WHEN x LIKE '%e' AND (regexp_matches(left(x, -1), '^[^aeiouy]*[aeiouy]+[^aeiouy]+[aeiouy]+[^aeiouy]') OR (regexp_matches(left(x, -1), '^[^aeiouy]*[aeiouy]+[^aeiouy]+[aeiouy]*$') AND NOT regexp_matches(left(x, -1), '[^aeiouy][aeiouy][^aeiouywxY]$'))) THEN left(x, -1) ELSE x END AS x FROM s10)
SELECT word, lower(CASE WHEN x LIKE '%ll' AND regexp_matches(x, '^[^aeiouy]*[aeiouy]+[^aeiouy]+[aeiouy]+[^aeiouy]') THEN left(x, -1) ELSE x END) AS stem FROM s11
UNION ALL SELECT word, word FROM w WHERE length(word) <= 2"""


@query("T3_stems", _STEMS)
def _(t: Tables):
    return stems.stems(t.documents.select(text.corpus_tokens("text").alias("w")), "w")
