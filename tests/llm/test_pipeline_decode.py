import corpus_pipeline
from pyspark.sql import functions as F

from alignforge.llm import sentencepiece_viterbi
from alignforge.llm.queries import tokenizer_path


def test_last_stage_tells_the_round_trip(spark):
    """The ids decode to the text, through the same pass and through the operator; a text that cannot come back is told."""
    rows = [(1, "a few words, some more"), (2, "the mark \u2581 decodes as a blank"), (3, None), (4, "\u8a9e and \U0001f600 \n x"), (4, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.tokens(spark, docs, "")
    assert sorted((r["doc_id"], r["round_trip"]) for r in got.collect()) == [(1, True), (2, False), (3, True), (4, True), (4, True)]
    assert got.where("n_tokens <> size(ids)").count() == 0
    path = tokenizer_path("piece_bpe_32k.model")
    both = sentencepiece_viterbi.decode(sentencepiece_viterbi.encode(docs, path, back=True), path, out_col="again")
    assert both.where(F.col("again") != F.col("decoded")).count() == 0
