"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns they were given. ``run`` writes each stage's rows as Parquet into the shared folder
and rereads them, so a lost executor never costs more than one stage; a stage's rows are removed
once the next one's are written, save the last, which the result reads.

Defined cases: documents without a letter (null, empty or blank text among them) are in no
language and go with the first stage; a null id never teaches and is judged by its text; rows of
one id are judged apart by their texts, of fully repeated rows one stays; ties go to the smallest
id; other columns pass untouched whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alignforge.llm import decontaminate, langid, minhash, sentencepiece_viterbi, toxicity
from alignforge.llm.common import discard, fold, saved, table
from alignforge.llm.queries import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the models know; they learn outside the held-out fold."""
    model = langid.fit(docs.where(fold(F.col("doc_id"), 4) != 2))
    return langid.keep_known(docs, model)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5; labels outside the held-out fold teach."""
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 5) != 0)
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return minhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, round_trip: whether the ids decode to the document's text)."""
    out = sentencepiece_viterbi.encode(docs, tokenizer_path("piece_bpe_32k.model"), back=True)
    same = F.crc32("decoded") == F.col("text_crc32")
    return out.select(F.col("id").alias("doc_id"), "ids", F.col("n_ids").alias("n_tokens"), same.alias("round_trip"))


STAGES = [
    ("language ID", language_id),
    ("toxicity", toxicity_filter),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding and decoding", tokens),
]

#: SQL cannot express the learned stages; tests hold run() against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, saved(stage(spark, docs, sf_dir))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
