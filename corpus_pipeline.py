"""The corpus pipeline: language ID, near-dedup, PII, mixing and token encoding, stage by stage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the next one's
docs. All but the last return the columns of documents. Rows without a doc_id, and rows with equal ids and different texts, are documents
like others. Empty tables pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import bpe_trie, langid, mixing, pii, similar
from foliospark.llm.common import read_table, written

#: Rows repeat at most this often when a source is short of its weight.
MAX_EPOCHS = 2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; lang becomes the predicted one."""
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    known = langid.predict(docs, model).filter("lang_pred <> 'und'")
    return known.withColumn("lang", F.col("lang_pred")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8 or more), found by SimHash and by whole shingle sets: the one with the smallest doc_id."""
    return similar.first_of_each(docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts replaced by the names of their kinds; n_chars follows."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as there are, shared out by the target weights; a row stands as often as it is taken."""
    return mixing.mixed(docs, F.col("tokens"), max_epochs=MAX_EPOCHS)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the digest of their decoded text."""
    return bpe_trie.round_trip(docs.select("doc_id", "lang", "source", "text"), keep_ids=True)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("redact_pii", redact_pii),
    ("mix_sources", mix_sources),
    ("encode_tokens", encode_tokens),
]
#: Regular-expression spans, components of similar shingle sets and BPE ids have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
