"""A corpus pipeline of five operators; each stage works on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm import bpe, jaccard, packing, quality, secrets, suffixes
from folioscope.llm.workspace import folder

#: No SQL expresses the classifier, the packing or the guess costs; tests hold the stages against brute force.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from labels that are not held out."""
    model = quality.classifier(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.scored(docs, model, with_text=True).filter("predicted = 1").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that with the least id; documents without words stay."""
    found = jaccard.near_classes(docs, with_key=True)
    # of rows alike in id and words one stays, too; dealt anew, so that the join before can split a class of many copies
    stay = found.filter("k1 is null or doc_id <=> class_id").select("doc_id", "k1", "k2").repartition("doc_id").distinct()
    keyed, back = _keyed(docs)
    on = [F.col(a).eqNullSafe(stay[b]) for a, b in (("_id", "doc_id"), ("_k1", "k1"), ("_k2", "k2"))]
    nth = F.row_number().over(Window.partitionBy("_id", "_k1", "_k2").orderBy(F.lit(0)))
    kept = keyed.join(stay, on, "left_semi")
    return kept.withColumn("_nth", nth).filter("_nth = 1 or _k1 is null").select(*back)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 50 or more words that occur earlier in the corpus."""
    found = suffixes.repeats(docs).filter(F.size("removed") > 0)
    keyed, back = _keyed(docs)
    joined = keyed.join(found, F.col("_id").eqNullSafe(found["doc_id"]) & (F.col("_k1") == found["k1"]), "left")
    text = f"_c{docs.columns.index('text')}"
    return _with_text(joined.withColumn(text, suffixes.cut_out(F.col(text), F.col("removed"))).select(*back), docs.columns)


def _keyed(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """Documents under names that clash with none, with _id and the hashes of their words; and the columns to go back."""
    names = {c: f"_c{k}" for k, c in enumerate(docs.columns)}
    inner = docs.select(*(F.col(c).alias(n) for c, n in names.items()))
    keyed = jaccard.with_keys(inner, names["text"]).withColumnsRenamed({"k1": "_k1", "k2": "_k2"}).withColumn("_id", F.col(names["doc_id"]))
    return keyed, [F.col(n).alias(c) for c, n in names.items()]


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced by a mark."""
    words = secrets.word_costs(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return _with_text(secrets.redacted(docs, words), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 ids, with the ids of each piece."""
    return packing.packed_documents(docs, bpe.tokenizer_json_of_file(public_tokenizers.path("byte_bpe_50k.json")), with_ids=True)


def _with_text(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, with the number of characters of the new text where there is such a column."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.char_length("text").cast("long"))
    return docs.select(*columns)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("secret scans", redact_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's rows written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = folder(spark, "stage")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
