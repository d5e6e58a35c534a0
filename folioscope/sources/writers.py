"""Sinks: canonical JSON lines, CSV manifests, rendered reports. None overwrites what is there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _ordered(value: Column, kind: T.DataType) -> Column:
    """A value whose structs have their fields in alphabetical order, at all depths."""
    if isinstance(kind, T.StructType):
        made = F.struct(*(_ordered(value[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)))
        return F.when(value.isNotNull(), made)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _ordered(x, kind.elementType))
    return value


def canonical_json(df: DataFrame) -> Column:
    """Each row as compact JSON with sorted keys; nulls are written."""
    fields = (_ordered(F.col(f.name), f.dataType).alias(f.name) for f in sorted(df.schema.fields, key=lambda f: f.name))
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def write_json_lines(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Canonical JSON lines; with an order, files hold consecutive ranges of it."""
    rows = df if order is None else df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows.select(canonical_json(df).alias("value")).write.mode("errorifexists").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def write_pages(df: DataFrame, path: str, by: str = "model") -> None:
    """Normalised pages as JSON, a folder for each model."""
    df.write.mode("errorifexists").partitionBy(by).json(path)


def fingerprint(df: DataFrame, order: list[str], by: list[str]) -> DataFrame:
    """SHA-256 of each group's canonical rows in order; a group's rows meet in one task, so groups are selections, not corpora."""
    row = canonical_json(df)
    grouped = df.withColumn("_json", row).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, "_json"))).alias("_rows"))
    return grouped.select(*by, F.sha2(F.array_join(F.transform("_rows", lambda r: r["_json"]), "\n").cast("binary"), 256).alias("fingerprint"))


def markdown(title: Column, sections: list[tuple[str, Column]]) -> Column:
    """A report as Markdown; sections are arrays of lines, empty ones are left out."""
    parts = [F.concat(F.lit("# "), title)]
    for name, lines in sections:
        parts.append(F.when(F.size(lines) > 0, F.concat(F.lit(f"## {name}\n\n- "), F.array_join(lines, "\n- "))))
    return F.concat_ws("\n\n", *parts)


def masked_secrets(text: Column, secrets: list[str], mark: str = "***") -> Column:
    for secret in sorted((s for s in secrets if s), key=len, reverse=True):
        text = F.replace(text, F.lit(secret), F.lit(mark))
    return text
