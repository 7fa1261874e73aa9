"""The registered queries of this subpackage: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_trie, bwt_dedup, conversation_trie, html_lstm, langid, line_hash, mixing, mpegts, phrases, pii, simhash_dedup, simhash_search, warc
from .common import read_table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    asked = docs.select("doc_id", (langid.fold() == 0).alias("held_out"), "text")
    return langid.predict(asked, model).drop("text")


def op2_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_trie.round_trip(docs)


def op3_mpeg_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = mpegts.write_streams(docs).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "media")
    sized = stored.withColumn("media_bytes", F.length("media").cast("long")).withColumn("media_sha256", F.sha2("media", 256))
    read = mpegts.read_streams(sized).drop("media")
    units = F.col("read.units")
    feature = F.concat_ws(
        ";",
        F.concat(F.lit("packets="), F.col("read.n_packets")),
        F.concat(F.lit("units="), F.size(units)),
        F.concat(F.lit("random_access="), F.size(F.filter(units, lambda u: u.random_access))),
        F.concat(F.lit("pts="), F.coalesce(F.array_min(units.pts), F.lit(0)), F.lit("-"), F.coalesce(F.array_max(units.pts), F.lit(0))),
        F.concat(F.lit("errors="), F.col("read.continuity_errors") + F.col("read.sync_errors") + F.col("read.table_errors")),
    )
    payload = F.col("read.payload")
    return read.select(
        "doc_id", "n_bytes", F.length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -32, 32)).alias("tail_crc32"), "media_bytes", "media_sha256", feature.alias("feature"),
    )


def op4_simhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_search.edited_likeness(read_table(spark, sf_dir, "documents"))


def op5_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.summary(read_table(spark, sf_dir, "pages"))


def op6_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(read_table(spark, sf_dir, "documents"))


def op7_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt_dedup.digest(read_table(spark, sf_dir, "documents"))


def op8_hierarchical_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(read_table(spark, sf_dir, "documents"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_components(read_table(spark, sf_dir, "documents"))


def op10_recurrent_block_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    weights = html_lstm.fit(pages)
    return html_lstm.extract(pages, weights).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op11_line_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_hash.digest(read_table(spark, sf_dir, "documents"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie_nodes(read_table(spark, sf_dir, "conversations"))


def op13_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_bpe_trie": op2_bpe_trie,
    "op3_mpeg_transport_streams": op3_mpeg_transport_streams,
    "op4_simhash_fingerprints": op4_simhash_fingerprints,
    "op5_warc_derivatives": op5_warc_derivatives,
    "op6_bootstrapped_pii": op6_bootstrapped_pii,
    "op7_run_length_index": op7_run_length_index,
    "op8_hierarchical_mixing": op8_hierarchical_mixing,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_recurrent_block_labeller": op10_recurrent_block_labeller,
    "op11_line_hash": op11_line_hash,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_phrase_automata": op13_phrase_automata,
}
