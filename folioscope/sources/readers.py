"""Readers: JSON lines (lenient and strict), JSON objects, CSV manifests, OCR results, file trees, images by stem.

All schemas are given, none is inferred. Bad rows are rows of their own, with a reason, or an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAD = "_bad"


class SourceError(ValueError):
    """A source that breaks its contract."""


def json_lines(spark: SparkSession, path: str, schema: T.StructType, strict: bool = False, max_characters: int | None = None, text: str = "text") -> DataFrame:
    """Objects of a JSON-lines source, with _bad (null, or why a line is no row).

    Lenient: blank lines are left out. Strict: a blank line is bad, and so is a repeated or an unknown key.
    """
    lines = spark.read.text(path).withColumnRenamed("value", "_line")
    blank = F.trim("_line") == ""
    if not strict:
        lines = lines.filter(~blank)
    whole = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    row = F.from_json("_line", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    parsed = lines.withColumn("_row", row)
    keys = F.json_object_keys("_line")
    rules = [F.when(blank, F.lit("blank line")), F.when(keys.isNull(), F.lit("not an object")), F.when(F.col("_row._corrupt").isNotNull(), F.lit("wrong type"))]
    if strict:
        rules += [F.when(F.try_parse_json("_line").isNull(), F.lit("repeated key")), F.when(F.size(F.array_except(keys, F.array(*map(F.lit, schema.names)))) > 0, F.lit("unknown key"))]
    out = parsed.select(*(F.col(f"_row.{n}").alias(n) for n in schema.names), F.coalesce(*rules).alias(BAD))
    return out if max_characters is None else out.filter(F.col(BAD).isNotNull() | (F.char_length(text) <= max_characters))


def numbered_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): lines with their number, each file in one task; for files of a bounded size."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split("value", "\n").alias("lines"))
    each = files.select("file", F.posexplode("lines").alias("line", "value"))
    return each.select("file", (F.col("line") + 1).alias("line"), "value").filter(F.trim("value") != "")


def json_objects(spark: SparkSession, path: str, schema: T.StructType, max_bytes: int = 1 << 20) -> DataFrame:
    """One object for each file, with _bad: too large, not valid UTF-8, or no object without repeated keys."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    text = F.try_validate_utf8(F.col("content").cast("string"))
    bad = F.coalesce(
        F.when(F.col("length") > max_bytes, F.lit("too large")), F.when(text.isNull(), F.lit("not UTF-8")), F.when(F.json_object_keys(text).isNull(), F.lit("not an object")), F.when(F.try_parse_json(text).isNull(), F.lit("repeated key"))
    )
    return files.select("path", F.from_json(text, schema).alias("row"), F.sha2("content", 256).alias("sha256"), bad.alias(BAD)).select("path", "row.*", "sha256", BAD)


def csv_manifest(spark: SparkSession, path: str, schema: T.StructType, domains: dict[str, list[str]] | None = None) -> DataFrame:
    """A CSV with a header and the given columns; _bad names the first column whose value is outside its domain."""
    header = spark.read.option("header", True).csv(path).columns
    missing = [n for n in schema.names if n not in header]
    if missing:
        raise SourceError(f"columns are missing: {', '.join(missing)}")
    typed = spark.read.option("header", True).csv(path).select(*(F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields))
    rules = [F.when(F.col(c).isNull() | ~F.col(c).isin(*allowed), F.lit(c)) for c, allowed in (domains or {}).items()]
    return typed.withColumn(BAD, F.coalesce(*rules) if rules else F.lit(None).cast("string"))


def marks_by_page(annotations: DataFrame) -> DataFrame:
    """Annotation rows (path, page_id, mark_x, ...) as one row for each page; all four mark columns or none."""
    marks = ["mark_x", "mark_y", "mark_width", "mark_height"]
    filled = sum((F.col(c).isNotNull().cast("int") for c in marks), F.lit(0))
    return annotations.groupBy("path", "page_id").agg(
        F.collect_list(F.when(filled == 4, F.struct(*marks))).alias("marks"), F.bool_or(~filled.isin(0, 4)).alias("partial_mark")
    )


OCR_RESULT = "map<string,array<struct<text_lines:array<struct<text:string,confidence:double,bbox:array<double>>>,page:int>>>"


def ocr_results(spark: SparkSession, path: str) -> DataFrame:
    """Results files (name -> pages of lines) as one row for each page; a name in two files is an error row."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", OCR_RESULT).alias("m"))
    each = files.select("file", F.explode("m").alias("source_name", "pages"))
    names = each.groupBy("source_name").agg(F.count_distinct("file").alias("files"))
    rows = each.select("source_name", F.posexplode("pages").alias("position", "p"))
    text = F.array_join(F.transform("p.text_lines", lambda x: x["text"]), "\n")
    out = rows.select("source_name", F.coalesce("p.page", F.col("position") + 1).alias("page_number"), text.alias("text"), F.size("p.text_lines").alias("blocks"))
    return out.join(names, "source_name").withColumn(BAD, F.when(F.col("files") > 1, F.lit("in several files"))).drop("files")


def markdown_results(spark: SparkSession, root: str) -> DataFrame:
    """Results as a text and a metadata file for each image (<stem>/<stem>.md, <stem>/<stem>_metadata.json), one row for each stem.

    (document_id, page_number, text, page, token_count, chunk_count, _bad); a missing file or another number of pages than one is bad.
    Spark's listing passes over empty files: an empty text file is bad as a missing one is, where other readers would take a blank page.
    """
    reader = lambda suffix: spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(root)
    stem = lambda suffix: F.substring_index(F.substring_index("path", "/", -1), suffix, 1).alias("document_id")
    content = F.col("content").cast("string")
    texts = reader(".md").select(stem(".md"), F.regexp_replace(F.make_valid_utf8(content), r"(?U)^\s+|\s+$", "").alias("text"), F.is_valid_utf8(content).alias("valid"))
    shape = "num_pages int, pages array<string>, total_token_count long, total_chunks long"
    known = reader("_metadata.json").select(stem("_metadata.json"), F.from_json(content, shape).alias("m"))
    one_page = F.coalesce("m.num_pages", F.lit(0)) == 1
    bad = F.when(F.col("text").isNull(), "no text").when(~F.col("valid"), "not UTF-8").when(F.col("m").isNull(), "no metadata").when(~one_page, "not one page")
    joined = texts.join(known, "document_id", "full_outer")
    return joined.select("document_id", F.lit(1).alias("page_number"), "text", F.get("m.pages", F.lit(0)).alias("page"), F.col("m.total_token_count").alias("token_count"), F.col("m.total_chunks").alias("chunk_count"), bad.alias(BAD))


def parallel_blocks(df: DataFrame, text: str = "text", **lists: str) -> DataFrame:
    """Rows that hold parallel arrays as an array of structs; blank texts go."""
    zipped = F.arrays_zip(F.col(text), *(F.col(c) for c in lists.values()))
    return df.withColumn("blocks", F.filter(zipped, lambda b: F.trim(b[text]) != ""))


def file_tree(spark: SparkSession, root: str, keep: str = ".*", leave: str = "a^") -> DataFrame:
    """(path, size, sha256) of the files below a folder by patterns on their paths."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.filter(F.col("path").rlike(keep) & ~F.col("path").rlike(leave)).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def files_by_stem(spark: SparkSession, root: str, suffixes: tuple[str, ...] = ("png", "jpg", "jpeg")) -> DataFrame:
    """(stem, path, length, content, _bad) of the files with a suffix; a stem of several files is bad."""
    files = spark.read.format("binaryFile").load(root).filter(F.lower("path").rlike(rf"\.({'|'.join(suffixes)})$"))
    named = files.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("stem"), "path", "length", "content")
    many = named.groupBy("stem").agg(F.count("*").alias("n"))
    return named.join(many, "stem").withColumn(BAD, F.when(F.col("n") > 1, F.lit("several files"))).drop("n")


def paired_by_stem(left: DataFrame, right: DataFrame) -> DataFrame:
    """(stem, left_path, right_path); a stem that one side lacks has a null there."""
    a, b = (x.select("stem", F.col("path").alias(n)) for x, n in ((left, "left_path"), (right, "right_path")))
    return a.join(b, "stem", "full_outer")
