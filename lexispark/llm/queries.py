"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexispark.llm.common import documents


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispark.llm.repeats import repeat_report

    return repeat_report(documents(spark, sf_dir))


def op2_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispark.llm.dialogues import perspectives

    return perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op3_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispark.llm.fingerprints import fingerprint_report

    return fingerprint_report(documents(spark, sf_dir))


def op4_toxicity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispark.llm.toxicity import fit, scored, train_labels

    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return scored(docs, fit(docs, train_labels(labels)))


def op5_bottom_k_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispark.llm.near_dups import near_duplicates

    return near_duplicates(documents(spark, sf_dir), percent=85).drop("tkey")


def op6_url_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispark.llm.urls import judged

    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_curriculum_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispark.llm.mixing import mix_report

    return mix_report(documents(spark, sf_dir))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispark.llm.packing import pack_documents

    return pack_documents(documents(spark, sf_dir), tokenizer_file())


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispark.llm.personal import personal_report

    return personal_report(documents(spark, sf_dir))


def op10_embedding_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispark.llm.vectors import vector_components

    return vector_components(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispark.llm.prefix_trie import rebuilt_trie

    return rebuilt_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_segment_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispark.llm.bpe import encoding_report

    return encoding_report(documents(spark, sf_dir), tokenizer_file())


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispark.llm.whitening import whitened

    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from lexispark.llm import dialogues, near_dups, prefix_trie, repeats, vectors

    return {"op1_suffix_array_dedup": repeats.SQL, "op2_perspective_rotation": dialogues.SQL, "op5_bottom_k_near_dups": near_dups.SQL, "op10_embedding_range_join": vectors.SQL, "op11_prefix_trie": prefix_trie.SQL}
