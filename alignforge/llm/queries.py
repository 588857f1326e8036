"""The registered queries of this subpackage: thin digests of the operators' outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, cover_tree, decontaminate, langid, minhash, pitman_yor, sentencepiece_viterbi, token_binary, toxicity, url_filter
from .common import fold, shared_dir, table


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary files are; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


# The rules the query judges by.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of a page: the quality label under its id."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return url_filter.judge(table(spark, sf_dir, "pages"), labels, RULES)


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: every row whose id is divisible by 20; candidates: all other rows."""
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("long").alias("id"), cover_tree.integer_vector(F.col("embedding"), 64).alias("v")
    )
    return cover_tree.top_k(rows, rows.where(F.col("id") % 20 == 0), 20)


def op3_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pitman_yor.score(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 10) == 0)
    return got.withColumnRenamed("id", "doc_id")


# How transcripts of the query write their speakers, one style a conversation.
STYLES = [
    {"user": "User: ", "assistant": "Assistant: ", "system": "System: "},
    {"user": "Human: ", "assistant": "AI: ", "system": "Instructions: "},
    {"user": "### Question:\n", "assistant": "### Answer:\n", "system": "### Context:\n"},
    {"user": "<|user|> ", "assistant": "<|assistant|> ", "system": "<|system|> "},
]


def raw_transcripts(conversations: DataFrame) -> DataFrame:
    """conversations as raw transcript pieces: speakers written into the text, one in five left out."""
    style = F.pmod(F.xxhash64("conv_id", F.lit(1)), F.lit(len(STYLES)))
    mark = F.lit("")
    for k, words in enumerate(STYLES):
        for role, word in words.items():
            mark = F.when((style == k) & (F.col("role") == role), F.lit(word)).otherwise(mark)
    lost = F.pmod(F.xxhash64("conv_id", "turn", F.lit(2)), F.lit(5)) == 0
    return conversations.withColumn("text", F.when(lost, F.col("text")).otherwise(F.concat(mark, F.col("text"))))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations are written as raw transcripts, then parsed without their role column."""
    raw = raw_transcripts(table(spark, sf_dir, "conversations"))
    model = chat_format.fit(raw.where(fold(F.col("conv_id"), 5) != 0))
    got = chat_format.parse(raw.drop("role"), model)
    return got.select("conv_id", F.col("position").alias("turn"), "line", "role", "n_lines", F.crc32("rendered").alias("rendered_crc32"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(fold(F.col("doc_id"), 5) != 0))
    return toxicity.score(docs, model).select(
        F.col("id").alias("doc_id"),
        (fold(F.col("id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


def op7_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    token_binary.write(table(spark, sf_dir, "documents"), folder, tokenizer_path("word_bpe_49k.json"), end_id=1)
    return token_binary.read(spark, folder).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(fold(F.col("doc_id"), 4) != 2))
    return langid.predict(docs, model).select(
        F.col("id").alias("doc_id"),
        (fold(F.col("id"), 4) == 2).alias("held_out"),
        "lang_pred",
        "score",
        "rejected",
    )


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sentencepiece_viterbi.encode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), back=True)
    return got.select(
        F.col("id").alias("doc_id"),
        "n_ids",
        "ids_crc32",
        (F.crc32("decoded") == F.col("text_crc32")).alias("round_trip"),
    )


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
