"""Personal data: fixed forms first, then bootstrapped contextual extraction. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import stored, text_of

KINDS = ("email", "ip", "card", "phone")
# The forms as the contract states them, written so that the regex engine never backtracks into a run: possessive
# runs, and a start that lies at a run's first character or where the last match ended.
FORMS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Stands for each character of a known span while candidates are sought.
MASK = "￼"
#: A candidate: a known span, a run of digit groups between single blanks, or a word with a digit or an @.
_GROUP = r"(?=[().+-]*+[0-9])[0-9().+-]++"
_NEXT = rf"\x20(?!\+){_GROUP}"
_END = r"(?=[)\]}>\"',;:!?.]*+(?:[\x20\x09-\x0D]|\z))"
#: Whole runs only; those of more than 19 groups have more digits than any kind, and the engine recurses by group.
_RUN = rf"(?<![^\x20\x09-\x0D])[\[{{<\"',;:!?]*+{_GROUP}{_END}(?:{_NEXT}{_END}){{1,18}}+(?!{_NEXT}{_END})"
_WORD = rf"(?<![^\x20\x09-\x0D])(?=[^\x20\x09-\x0D0-9@]*+[0-9@])[^\x20\x09-\x0D{MASK}]++(?!{MASK})"
CANDIDATE = f"{MASK}++|{_RUN}|{_WORD}"
_SPAN = "array<struct<start:bigint,end:bigint,value:string,before:string,after:string>>"
#: Words of context are sought in so many pieces between blanks, before and after, on the same line.
PIECES = 4
#: Matches whose places are summed at once.
BLOCK = 100


def _located(text: Column, pattern: str, around: bool = False) -> Column:
    """All matches as structs start, end (code points), value, and with `around` the last pieces of the line before
    and the first ones of the line after it, as far as the next matches."""
    none = F.lit(None).cast("string")

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        before = F.substring_index(F.substring_index(x["gap"], "\n", -1), " ", -PIECES) if around else none
        after = F.substring_index(F.substring_index(x["next"], "\n", 1), " ", PIECES) if around else none
        one = F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), x["hit"].alias("value"), before.alias("before"), after.alias("after"))
        more = F.when(x["hit"].isNull(), F.array().cast(_SPAN)).otherwise(F.array(one).cast(_SPAN))
        return F.struct(end.cast("long").alias("pos"), F.concat(acc["out"], more).alias("out"))

    # block by block, as an array grows at the cost of its length each time
    def block(acc: Column, part: Column) -> Column:
        zero = F.struct(acc["pos"].alias("pos"), F.array().cast(_SPAN).alias("out"))
        return F.aggregate(part, zero, step, lambda own: F.struct(own["pos"].alias("pos"), F.concat(acc["parts"], F.array(own["out"])).alias("parts")))

    def located(every: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(every) - 1) / BLOCK).cast("int")), lambda k: F.slice(every, k * BLOCK + 1, F.lit(BLOCK)))
        zero = F.struct(F.lit(0).cast("long").alias("pos"), F.array().cast(f"array<{_SPAN}>").alias("parts"))
        return F.aggregate(parts, zero, block, lambda acc: F.flatten(acc["parts"]))

    def zipped(found: Column) -> Column:
        columns = [found["gaps"].alias("gap"), found["hits"].alias("hit")]
        return F.arrays_zip(*columns, *([F.slice(found["gaps"], F.lit(2), F.size(found["gaps"])).alias("next")] if around else []))

    # lambdas over arrays of one, so that what is found is worked out once
    once = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    found = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    return F.when(text.rlike(pattern), once(once(found, zipped), located)).otherwise(F.array().cast(_SPAN))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def step(acc: Column, i: Column) -> Column:
        d = F.substr(back, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _fits(kind: str, value: Column) -> Column:
    if kind == "ip":
        small = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(small(p)) <= 3) & (F.substr(small(p), F.lit(1), F.lit(4)).cast("int") <= 255))
    if kind == "card":
        return F.when(F.length(_digits(value)).between(16, 19), _luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """All spans of the fixed forms: array of (kind number, start, end), by kind, then start."""
    def of(i: int, kind: str) -> Column:
        right = F.filter(_located(text, FORMS[kind]), lambda s: _fits(kind, s["value"]))
        return F.transform(right, lambda s: F.struct(F.lit(i).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    every = [of(i, kind) for i, kind in enumerate(KINDS)]
    return F.concat(*every)


def _loose(value: Column) -> Column:
    """Kinds that a word or a run of digit groups could be, by its looks alone."""
    digits, plain = F.length(_digits(value)), value.rlike(r"^[0-9().+\x20-]+$")
    looks = (value.rlike(r"^[^@]+@[^@]+$"), value.rlike(r"^[0-9A-Fa-f]+([.:][0-9A-Fa-f]+){3,7}$"), plain & digits.between(13, 19), plain & digits.between(7, 15))
    return F.filter(F.array(*(F.when(x, F.lit(i)) for i, x in enumerate(looks))), lambda k: k.isNotNull())


def _masked(text: Column, spans: Column) -> Column:
    """The text with each character of the spans as MASK, so that positions stay."""
    def step(acc: Column, s: Column) -> Column:
        start = F.greatest(acc["end"], s["start"])
        gap = F.substr(text, (acc["end"] + 1).cast("int"), (start - acc["end"]).cast("int"))
        hidden = F.repeat(F.lit(MASK), F.greatest(F.lit(0), s["end"] - start).cast("int"))
        return F.struct(F.greatest(acc["end"], s["end"]).alias("end"), F.concat(acc["out"], F.array(gap, hidden)).alias("out"))

    zero = F.struct(F.lit(0).cast("long").alias("end"), F.array().cast("array<string>").alias("out"))
    last = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, (acc["end"] + 1).cast("int"), F.lit(2**31 - 1)))
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    return F.when(F.size(spans) > 0, F.aggregate(by_start, zero, step, last)).otherwise(text)


def _contexts(before: Column, after: Column) -> Column:
    """The lexical patterns that a candidate stands in: the word before it, the two words before it, and the word
    before with the word after; each with a line for the candidate. Without a word before there are none."""
    words = F.regexp_extract_all(F.lower(before), F.lit(r"\p{L}+"), F.lit(0))
    behind = F.regexp_extract(F.lower(after), r"\p{L}+", 0)
    one, two = F.get(words, F.size(words) - 1), F.get(words, F.size(words) - 2)
    patterns = F.array(F.concat(one, F.lit(" _")), F.concat(two, F.lit(" "), one, F.lit(" _")), F.when(behind != "", F.concat(one, F.lit(" _ "), behind)))
    return F.filter(patterns, lambda p: p.isNotNull())


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, key (of rows with equal doc_id and text), spans, and candidates in context: one pass over the texts.

    A known span is one candidate as a whole. Of a run of digit groups the first word alone is the candidate where it
    could be an identifier by itself, else the run. Its context lies between the candidates next to it, on its line."""
    text = text_of()
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), text).alias("key"), text.alias("text"))
    d = d.withColumn("spans", base_spans(F.col("text")))
    d = d.withColumn("masked", _masked(F.col("text"), F.col("spans")))

    def bare(value: Column, lead: str) -> Column:
        return F.regexp_replace(F.regexp_replace(value, lead, ""), r"[)\]}>\"',;:!?.]+$", "")

    def candidate(s: Column) -> Column:
        # of a run, a bracket stays that closes before another digit
        word, run = r"^[(\[{<\"',;:!?]+", r"^(?:[\[{<\"',;:!?]|\((?![^()]*\)[^)]*[0-9]))+"
        first = bare(F.substring_index(s["value"], " ", 1), word)
        whole = F.contains(s["value"], F.lit(" ")) & (F.size(_loose(first)) == 0)
        value = F.when(whole, bare(s["value"], run)).otherwise(first)
        lead = F.length(F.when(whole, F.regexp_extract(s["value"], run, 0)).otherwise(F.regexp_extract(s["value"], word, 0)))
        start = s["start"] + lead
        return F.struct(value.alias("value"), start.cast("long").alias("start"), (start + F.length(value)).cast("long").alias("end"), s["before"].alias("before"), s["after"].alias("after"))

    d = d.withColumn("found", F.transform(_located(F.col("masked"), CANDIDATE, around=True), candidate))

    def known(c: Column) -> Column:
        over = F.filter(F.col("spans"), lambda s: (s["start"] < c["end"]) & (s["end"] > c["start"]))
        hit = F.size(over) > 0
        kinds = F.when(hit, F.array(F.get(over, F.lit(0))["kind"])).otherwise(_loose(c["value"]))
        contexts = F.when(F.size(kinds) > 0, _contexts(c["before"], c["after"])).otherwise(F.array().cast("array<string>"))
        value = F.when(hit, F.substr(F.col("text"), (c["start"] + 1).cast("int"), (c["end"] - c["start"]).cast("int"))).otherwise(c["value"])
        return F.struct(contexts.alias("contexts"), F.xxhash64(F.lower(value)).alias("value"), c["start"].alias("start"), c["end"].alias("end"), hit.alias("known"), kinds.alias("kinds"))

    return d.select("doc_id", "key", "spans", F.filter(F.transform("found", known), lambda c: F.size(c["contexts"]) > 0).alias("found"))


def patterns(found: DataFrame, sure: float = 0.8, support: int = 5) -> DataFrame:
    """(context, kind): lexical patterns that nearly always stand before an identifier of that kind.

    The graph has an edge for each pattern (a context, with the kind) and instance (the identifier itself). Known
    instances score 1. A pattern scores the share of its distinct instances' scores, one more counted against it; an
    unseen instance scores as its best trusted pattern. Scores only rise, and rounds go on until none does, to six
    digits. Aggregates with partial sums only; the driver gets two sums a round."""
    edges = found.select(F.explode("contexts").alias("context"), "kinds", "value", "known").select("context", F.explode("kinds").alias("kind"), "value", "known")
    edges = stored(edges.groupBy("context", "kind", "value").agg(F.max(F.col("known").cast("double")).alias("score")), "edges")
    scored, was = edges, None
    while True:
        best = scored.groupBy("context", "kind").agg((F.sum("score") / (F.count("*") + 1)).alias("trust"), F.sum((F.col("score") > 0).cast("int")).alias("n"))
        best = stored(best.where((F.col("trust") >= sure) & (F.col("n") >= support)).select("context", "kind", "trust"), "trusted")
        now = tuple(best.agg(F.count("*"), F.sum(F.round("trust", 6).cast("decimal(38,6)"))).first())
        if now == was:
            return best.select("context", "kind")
        was = now
        reached = edges.join(best, ["context", "kind"]).groupBy("kind", "value").agg(F.max("trust").alias("reached"))
        scored = edges.join(reached, ["kind", "value"], "left").select("context", "kind", "value", F.greatest("score", F.coalesce("reached", F.lit(0.0))).alias("score"))


def found_spans(docs: DataFrame, **options) -> DataFrame:
    """doc_id, key, spans (the fixed forms'), more (those that patterns add): arrays of (kind number, start, end).

    A null text is empty and has none; a null doc_id stays null; repeated rows each get the same spans; other columns
    are ignored; no rows give no rows."""
    base = stored(scanned(docs), "personal")
    found = base.select("key", F.explode("found").alias("c")).select("key", "c.*")
    good = patterns(found, **options)
    new = found.where(~F.col("known")).select("key", F.explode("contexts").alias("context"), "kinds", "start", "end").select("key", "context", F.explode("kinds").alias("kind"), "start", "end").join(good, ["context", "kind"])
    more = new.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("kind", "start", "end"))).alias("more")).withColumnRenamed("key", "p_key")
    none = F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")
    return base.join(more, F.col("key") == F.col("p_key"), "left").select("doc_id", "key", "spans", F.coalesce("more", none).alias("more"))


def _said(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), (k + 1).cast("int"))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of the fixed forms), base_sha256, spans (all); see found_spans()."""
    number = lambda i: F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long")
    counts = [number(i).alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    every = F.array_sort(F.array_union("spans", "more"))
    return found_spans(docs, **options).select("doc_id", *counts, F.sha2(_said(F.col("spans")), 256).alias("base_sha256"), _said(every).alias("spans"))


def redacted(docs: DataFrame, **options) -> DataFrame:
    """docs with each span's text replaced by [EMAIL], [IP], [CARD] or [PHONE]; spans that overlap become one, named
    after the first. Texts without spans stay as they are, nulls too. An n_chars column is set anew. Scratch columns
    stand beside the row, so docs may have columns of any name."""
    spans = found_spans(docs, **options).where("size(spans) + size(more) > 0").select(F.col("key").alias("p_key"), F.array_sort(F.transform(F.array_union("spans", "more"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))).alias("p_spans")).dropDuplicates(["p_key"])
    keyed = docs.select(F.struct("*").alias("row"), F.xxhash64(F.col("doc_id").cast("long"), text_of()).alias("r_key"))
    full = keyed.join(spans, F.col("r_key") == F.col("p_key"), "left")
    tag = lambda k: F.element_at(F.array(*(F.lit(f"[{x.upper()}]") for x in KINDS)), (k + 1).cast("int"))
    was = F.col("row")["text"]

    def step(acc: Column, s: Column) -> Column:
        gap = F.substr(was, (acc["end"] + 1).cast("int"), (s["start"] - acc["end"]).cast("int"))
        new = s["start"] >= acc["end"]
        return F.struct(F.greatest(acc["end"], s["end"]).alias("end"), F.when(new, F.concat(acc["out"], F.array(gap, tag(s["kind"])))).otherwise(acc["out"]).alias("out"))

    zero = F.struct(F.lit(0).cast("long").alias("end"), F.array().cast("array<string>").alias("out"))
    last = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(was, (acc["end"] + 1).cast("int"), F.lit(2**31 - 1)))
    full = full.withColumn("r_text", F.when(F.col("p_spans").isNull(), was).otherwise(F.aggregate("p_spans", zero, step, last)))
    kinds = dict(docs.dtypes)
    columns = [F.col("r_text").alias(c) if c == "text" else F.length("r_text").cast(kinds[c]).alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c in docs.columns]
    return full.select(*columns)
