"""Queries whose operators need Python, and the stream; tests hold them against brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import python_functions as P
from folioscope.operators import learning, pixels, selection
from folioscope.plans.registry import query
from folioscope.session import scratch, table
from folioscope.streaming import landing


@query("html_to_text")
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", P.html_to_text("html").alias("text"))


@query("composed_text")
def composed_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", P.nfc("text").alias("nfc"), P.folded("text").alias("folded"))


@query("pii_spans")
def pii_spans(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", P.pii_spans("text").alias("spans"))


@query("fuzzy_markers")
def fuzzy_markers(spark, sf_dir):
    """Markers of a Hebrew line that is put before each text."""
    return table(spark, sf_dir, "documents").select("doc_id", P.marker_forms(F.concat(F.lit("הסכם שכירות בין חשוכר לבין המשכיר ארנונא "), "text")).alias("markers"))


@query("alignment_slices")
def alignment_slices(spark, sf_dir):
    """Edits between each 60 characters of each text and the 60 that begin 3 later, by class of character."""
    return P.slice_edits(table(spark, sf_dir, "documents"), "text", 60, 3)


@query("word_similarities")
def word_similarities(spark, sf_dir):
    """Each text and the same text from its 20th character on."""
    return table(spark, sf_dir, "documents").select("doc_id", F.round(P.word_likeness("text", F.expr("substring(text, 20)")), 6).alias("similarity"))


@query("logical_order")
def logical_order(spark, sf_dir):
    """Each line of each text, with a right-to-left word before it."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("line", "text"))
    return lines.select("doc_id", "line", P.logical_order(F.concat(F.lit("(בא) "), "text")).alias("text"))


@query("quota_selection")
def quota_selection(spark, sf_dir):
    """Ten picks from each hundred documents of a language."""
    i = F.col("doc_id")
    pool = table(spark, sf_dir, "documents").select(
        F.concat_ws("-", "lang", F.floor(i / 1000).cast("string")).alias("group_id"), i.cast("string").alias("item_id"), (i % 7).alias("page"), i.alias("line"),
        (F.col("n_chars") % 100 / 100).alias("score"), F.when(i % 2 == 0, F.lit(0.5)).alias("body"), F.when(i % 3 == 0, F.lit(0.4)).alias("clause"),
    )
    return selection.greedy_quota(pool, {"clause": 4, "body": 6})


@query("leave_one_source_out")
def leave_one_source_out(spark, sf_dir):
    """Scores of all labelled documents by a model of the other languages' labels."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.log1p("n_chars").alias("f1"), (F.regexp_count("text", F.lit("[^A-Za-zÀ-ÿ ]")) / F.greatest("n_chars", F.lit(1))).alias("f2"))
    rows = d.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return learning.leave_one_out(rows, "lang", ["f1", "f2"], "quality", "doc_id").withColumn("score", F.round("score", 6))


@query("page_lines")
def page_lines(spark, sf_dir):
    """Lines of small drawn pages, one for each document."""
    i = F.col("doc_id")
    bars = F.transform(F.sequence(F.lit(0), F.lit(40 * 30 - 1)), lambda p: F.when((F.floor(p / 40) % (4 + i % 5) >= 2) & (p % 40 >= i % 11) & (p % 40 < 30), 0).otherwise(255))
    drawn = table(spark, sf_dir, "documents").select(i.cast("string").alias("page_id"), F.lit(40).alias("width"), F.lit(30).alias("height"), bars.alias("pixels"))
    return pixels.page_lines(drawn)


@query(
    "stream_hourly_counts",
    "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
)
def stream_hourly_counts(spark, sf_dir):
    """Events as a stream, counted by hour in batches that each replace themselves; partial counts are added up when read."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    out = scratch(spark, "stream")
    counted = lambda df: df.groupBy(F.date_trunc("hour", "ts").alias("window_start"), "event_type").agg(F.count("*").alias("n"))
    landing.append_batches(stream, f"{out}/rows", f"{out}/state", counted).awaitTermination()
    return spark.read.parquet(f"{out}/rows").groupBy("window_start", "event_type").agg(F.sum("n").alias("n"))
