"""Report files: nested JSON documents and flat CSV tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CORRUPT = "_corrupt_record"


def nest(rows: DataFrame, name: str, order: list[str], by: list[str] | None = None) -> DataFrame:
    """Report rows as one ordered array column, in a single row or in one per group of `by`.

    A document holds its rows in one cell; give a report that grows with the data `by`, so
    that each of its documents stays small.
    """
    by = by or []
    fields = [c for c in rows.columns if c not in by]
    cells = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("_rank"), F.struct(*fields).alias("row"))))
    return rows.groupBy(*by).agg(F.transform(cells, lambda c: c["row"]).alias(name))


def one_row(*aggregates: DataFrame) -> DataFrame:
    """Several single-row results with different columns as one row."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), aggregates)
    return rows.agg(*[F.any_value(c, F.lit(True)).alias(c) for c in rows.columns])


def summary_document(scalars: dict[str, Column], tables: dict[str, DataFrame]) -> DataFrame:
    """One row: scalar fields plus one array field per nested table (see `nest`)."""
    document = one_row(*tables.values())
    return document.select(*[c.alias(n) for n, c in scalars.items()], *tables)


def write_report(df: DataFrame, path: str, fmt: str, columns: list[str] | None = None,
                 mode: str = "errorifexists") -> None:
    """Write JSON, or CSV with a header; `columns` selects and orders a subset."""
    rows = df.select(*columns) if columns else df
    if fmt == "json":
        rows.write.mode(mode).option("ignoreNullFields", False).json(path)
    elif fmt == "csv":
        rows.write.mode(mode).option("header", True).csv(path)
    else:
        raise ValueError("fmt must be 'json' or 'csv'")


def read_csv_report(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return (
        spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)
    )


def read_json_report(
    spark: SparkSession, path: str, schema: T.StructType | str, multi_line: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(documents, unreadable): text that is not one JSON object is set aside as `value`.

    A file is one document, or one document per line without `multi_line`.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    full = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
    text = spark.read.option("wholetext", multi_line).text(path).where(F.trim("value") != "")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    rows = text.withColumn("_doc", F.from_json("value", full, options))
    is_object = F.json_object_keys("value").isNotNull()
    readable = F.coalesce(is_object & F.col(f"_doc.{_CORRUPT}").isNull(), F.lit(False))
    good = rows.where(readable).select("_doc.*").drop(_CORRUPT)
    return good, rows.where(~readable).select("value")


def inline_rows(document: DataFrame, name: str) -> DataFrame:
    """A nested table of a document as rows with their `position`."""
    return document.select(F.posexplode(name).alias("position", "_row")).select("position", "_row.*")
