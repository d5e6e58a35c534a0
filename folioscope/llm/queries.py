"""One query for each operator of this subpackage, over its whole table, and the pipeline."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import bpe, jaccard, merkle, ogg, oracles, packing, quality, secrets, sharding, suffixes, warc
from folioscope.llm.workspace import written
from folioscope.session import table

QUERIES = {}
ORACLE_SQL = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


@query("op4_ogg_media")
def op4_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each whole text stored as an Ogg file, read back and described."""
    return ogg.media_columns(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op2_byte_bpe")
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each whole text encoded by the rank file and decoded again."""
    definition = bpe.tokenizer_json_of_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.round_trip_digests(table(spark, sf_dir, "documents").select("doc_id", "text"), definition)


@query("op6_shortest_pack_first")
def op6_shortest_pack_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 ids."""
    definition = bpe.tokenizer_json_of_file(public_tokenizers.path("byte_bpe_50k.json"))
    return packing.packed_documents(table(spark, sf_dir, "documents"), definition)


@query("op10_secret_guess_cost")
def op10_secret_guess_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in each whole text: fixed patterns and values that are costly to guess."""
    words = secrets.word_costs(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    found = secrets.secret_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), words, with_text=False)
    base = F.filter("secrets", lambda s: s["kind"] != "guess")
    return found.select(
        "doc_id",
        *(F.size(secrets.of_kind("secrets", k)).cast("long").alias(f"n_{k}") for k in secrets.KINDS),
        F.sha2(secrets.joined(base), 256).alias("base_sha256"),
        secrets.joined(F.col("secrets")).alias("spans"),
        F.array_max(F.transform("secrets", lambda s: s["cost"])).alias("max_cost"),
    )


@query("op8_hypergeometric_shards")
def op8_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards, a uniform shuffle with shard sizes at most one apart."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("row"))
    # written, so that a row keeps its number
    placed = sharding.shuffled_shards(written(docs, "sizes"), text="text_crc32", row="row")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op9_merkle_fingerprints", oracles.merkle(merkle.PARAGRAPHS, merkle.LEAVES))
def op9_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each whole text's fingerprint beside those of its edited text and of the next document."""
    return merkle.edited_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op3_nb_svm_quality")
def op3_nb_svm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each whole text's quality score by a model of the labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.classifier(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query("op1_ngram_jaccard", oracles.NGRAM_JACCARD)
def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's near-duplicate class and number of links at 5-word Jaccard similarity 0.8."""
    return jaccard.near_classes(table(spark, sf_dir, "documents"))


@query("op7_sparse_suffixes", oracles.SPARSE_SUFFIXES)
def op7_sparse_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with passages of at least 50 words that occur elsewhere, their spans, and how much of them dedup takes."""
    found = suffixes.repeats(table(spark, sf_dir, "documents"))
    listed = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    lost = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", F.size("spans").alias("n_spans"), listed.alias("spans"), lost.alias("removed_chars"))


@query(
    "op5_warc_transactions",
    """WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS s FROM pages),
    g AS (SELECT s, max(page_id) AS top FROM p GROUP BY s)
    SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
    array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST(('0x' || substr(p.s, 5 * (k // 4) + 1, 5)) AS BIGINT) >> (15 - 5 * (k % 4))) & 31 AS BIGINT) + 1, 1) FOR k IN range(32)], '') AS payload_digest,
    CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
    FROM p JOIN g ON p.s = g.s""",
)
def op5_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's capture, from archives that were written and read back."""
    found = warc.page_captures(table(spark, sf_dir, "pages"))
    revisit = F.col("response.type") == "revisit"
    return found.select(
        "page_id",
        F.col("original_bytes").alias("payload_bytes"),
        F.col("response.digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.when(revisit, F.col("original_page")).alias("refers_to"),
    )


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of the corpus pipeline over all documents."""
    return corpus_pipeline.run(spark, sf_dir)
