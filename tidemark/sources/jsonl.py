"""Event logs as JSON lines: strict and lenient reading, appending, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def parse_jsonl(lines: DataFrame, schema: StructType, col: str = "value") -> DataFrame:
    """One row per line; blank lines are skipped, a broken line fails the job."""
    used = lines.filter(F.trim(F.col(col)) != "")
    return used.select(F.from_json(F.trim(F.col(col)), schema, {"mode": "FAILFAST"}).alias("j")).select("j.*")


def parse_jsonl_lenient(lines: DataFrame, schema: StructType, col: str = "value") -> DataFrame:
    """Rows plus ``_bad``: null for a good line, else the text of a broken or non-object line."""
    wide = StructType([*schema.fields, StructField("_bad", StringType())])
    text = F.trim(F.col(col))
    parsed = lines.filter(text != "").select(
        text.alias("_text"),
        F.from_json(text, wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("j"),
    )
    not_object = ~F.col("_text").startswith("{")
    return parsed.select("j.*", F.when(not_object, F.col("_text")).otherwise(F.col("j._bad")).alias("_why")).drop("_bad").withColumnRenamed("_why", "_bad")


def scan_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return parse_jsonl(read_lines(spark, path), schema)


def scan_jsonl_lenient(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(good rows, one-row count of skipped lines)."""
    rows = parse_jsonl_lenient(read_lines(spark, path), schema)
    return rows.filter("_bad IS NULL").drop("_bad"), rows.agg(F.count("_bad").alias("skipped"))


def sink_append(rows: DataFrame, path: str, issued_ms: str = "issued_ms") -> None:
    """Append rows under their issue date; nothing stored before is rewritten."""
    dated = rows.withColumn("issue_date", F.date_format(F.timestamp_millis(F.col(issued_ms)), "yyyy-MM-dd"))
    dated.repartition("issue_date", F.pmod(F.hash(*rows.columns), F.lit(16))).write.mode("append").partitionBy("issue_date").parquet(path)


def report_document(rows: DataFrame) -> DataFrame:
    """Each row as a key-sorted JSON document."""
    return rows.select(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}).alias("document"))


def sink_report(rows: DataFrame, path: str, pretty: bool = True) -> None:
    """Write metric rows as (pretty) key-sorted JSON documents."""
    doc = F.to_json(F.struct(*sorted(rows.columns)), {"pretty": str(pretty).lower(), "ignoreNullFields": "false"})
    rows.select(doc.alias("value")).write.mode("overwrite").text(path)
