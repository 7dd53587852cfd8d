"""The corpus queries, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import (
    bpe,
    chat,
    exact_dedup,
    hard_negatives,
    importance,
    langid,
    mixing,
    near_dedup,
    repeats,
    sharding,
    token_files,
    topk_hash,
    toxicity,
)
from riskloom.llm.common import table
from riskloom.llm.sql import CHAT_SQL, EXACT_DEDUP_SQL, HARD_NEGATIVES_SQL, IMPORTANCE_SQL, MIXING_SQL, NEAR_DEDUP_SQL, TOPK_SQL

SHARDS = 8
NEIGHBOURS = 10


def near_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=4, similarity=80)


def repeats_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), text=False).drop("kept", "spans")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def bpe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary_path(), ids=False)
    return coded.drop("ids")


def langid_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def shard_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def chat_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two layouts: the table's turn rows, and one nested record of control strings."""
    rows = chat.canonical_turns(table(spark, sf_dir, "conversations"), (chat.TURN_ROW,))
    marks = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame(
        [(-1, [("user", marks), ("assistant", marks)])], "conv_id bigint, messages array<struct<role:string,content:string>>"
    )
    back = chat.read_back(chat.format_chats(rows.unionByName(chat.canonical_turns(probe))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )


def exact_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def topk_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by 50, against all rows."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return topk_hash.nearest(rows, rows.where("id % 50 = 0"), NEIGHBOURS)


def mixing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def hard_negatives_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose vec_id is divisible by 100; every seventh label is one off."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), F.col("embedding").alias("vector"))
    return hard_negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0)


def importance_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def token_files_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {
    "op1_language_id": (langid_query, None),
    "op2_near_dedup": (near_dedup_query, NEAR_DEDUP_SQL),
    "op3_suffix_dedup": (repeats_query, None),
    "op4_bpe": (bpe_query, None),
    "op5_toxicity": (toxicity_query, None),
    "op6_sharding": (shard_query, None),
    "op7_chat_formatting": (chat_query, CHAT_SQL),
    "op8_exact_dedup": (exact_dedup_query, EXACT_DEDUP_SQL),
    "op9_topk_search": (topk_query, TOPK_SQL),
    "op10_mixing": (mixing_query, MIXING_SQL),
    "op11_hard_negatives": (hard_negatives_query, HARD_NEGATIVES_SQL),
    "op12_importance": (importance_query, IMPORTANCE_SQL),
    "op13_token_files": (token_files_query, None),
}
