"""Corpus pipeline over `documents`: toxicity, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns the columns of
documents; the last returns packed pieces. run() writes no files of its own but those of the operators.

In every stage null texts count as empty, further columns are handed on whatever their names, and an empty table gives
an empty one; what becomes of null ids, ties and repeated rows stands with each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexispark.llm.common import drop_stored, stored
from lexispark.llm.mixing import mix_rows
from lexispark.llm.near_dups import without_near_duplicates
from lexispark.llm.packing import pack_documents
from lexispark.llm.personal import redacted
from lexispark.llm.queries import tokenizer_file
from lexispark.llm.toxicity import fit, train_labels, without_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learned from the labels that are not held out, does not reject. A score of the
    threshold itself rejects; null ids and repeated rows are judged by their texts; without labels all stay."""
    labels = train_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return without_toxic(docs, fit(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group of near-duplicates (80 % of their shingles or more). Rows
    that repeat a doc_id and its text are one document; of a group without ids one document stays; texts without words
    are near to nothing, so they stay."""
    return without_near_duplicates(docs, percent=80)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by the names of their kinds. A null text stays null; repeated rows and
    null ids are treated alike; of spans that overlap the first names the kind."""
    return redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in training order. Texts without words are never taken; a null source
    is one of its own; repeated rows are taken one by one; equal places are ordered by doc_id."""
    return mix_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows as pieces of sequences of at most 4096 tokens; repeated rows as often as they come, a null id as null."""
    return pack_documents(docs, tokenizer_file())


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("personal_data", redact_personal_data), ("mixing", mix_sources), ("packing", pack)]

#: The lexicon is learned, components are found step by step, and the tokenizer is a library: no SQL for that.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over `documents`, each one's result written and read again, and dropped once the next one's
    is there."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop_stored(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
