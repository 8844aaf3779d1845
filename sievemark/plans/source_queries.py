"""Queries of the readers: each writes the corpus as an archive into the shared folder and reads it back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.session import ensure_checkpoint_dir, table
from sievemark.sources import readers

_OWN = ["ccn", "survey_date", "f_tag", "narrative", "scope_severity", "is_complaint", "state"]


def _folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Record fields as text, without null or empty ones (a CSV file cannot tell these apart)."""
    c = table(spark, d, "corpus").select(*[F.col(k).cast("string").alias(k) for k in _OWN])
    return c.select(*[F.nullif(F.regexp_replace(k, r"\r\n?|\n", "\n"), F.lit("")).alias(k) for k in _OWN])


def csv_archive(spark: SparkSession, d: str) -> DataFrame:
    """Records written as CSV with line breaks and quotes inside fields, and read as an archive."""
    folder = _folder(spark, "csv")
    _records(spark, d).withColumnRenamed("ccn", "Facility Number").write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder)
    return readers.read_archives(spark, folder, "csv", {"ccn": "facility_number"}).select(*_OWN)


def jsonl_archive(spark: SparkSession, d: str) -> DataFrame:
    folder = _folder(spark, "jsonl")
    _records(spark, d).write.json(folder)
    return readers.read_archives(spark, folder, "jsonl").select(*_OWN)


def archive_places(spark: SparkSession, d: str) -> DataFrame:
    """How many files an archive of four files has, and whether every file's places run from 0 without a gap."""
    folder = _folder(spark, "places")
    _records(spark, d).repartition(4).write.json(folder)
    by_file = readers.read_archives(spark, folder, "jsonl").groupBy("file_name").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("offset").alias("k"), F.max("offset").alias("last"))
    return by_file.agg(F.sum("n").cast("bigint").alias("n_rows"), F.bool_and((F.col("k") == F.col("n")) & (F.col("last") == F.col("n") - 1)).alias("in_order"))


def text_reports(spark: SparkSession, d: str) -> DataFrame:
    """A report for each facility and day with a block for each tag, written and read whole."""
    c = table(spark, d, "corpus").select(F.regexp_extract(F.trim("ccn"), r"^(\d{6})$", 1).alias("ccn"), F.regexp_extract("survey_date", r"^(\d{4}-\d{2}-\d{2})$", 1).alias("day"), F.regexp_extract("f_tag", r"^(F\d{3,4})$", 1).alias("tag"))
    c = c.where("ccn != '' and day != '' and tag != ''").distinct()
    report = c.groupBy("ccn", "day").agg(F.array_join(F.transform(F.array_sort(F.collect_set("tag")), lambda t: F.concat(t, F.lit(" text of the tag"))), "\n").alias("body"))
    folder = _folder(spark, "reports")
    report.select(F.concat(F.lit("CCN: "), "ccn", F.lit("\nDATE: "), "day", F.lit("\n"), "body").alias("value"), F.concat("ccn", F.lit("_"), "day").alias("report")).write.partitionBy("report").text(folder)
    return readers.read_archives(spark, f"{folder}/*/*.txt", "text").select("ccn", "survey_date", "f_tag", "narrative")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (csv_archive, jsonl_archive, archive_places, text_reports)}
_SAME = "SELECT " + ", ".join(f"nullif(regexp_replace({k}::VARCHAR, '\\r\\n?|\\n', chr(10), 'g'), '') AS {k}" for k in _OWN) + " FROM corpus"
SQL: dict[str, str] = {
    "csv_archive": _SAME,
    "jsonl_archive": _SAME,
    "archive_places": "SELECT count(*)::BIGINT AS n_rows, true AS in_order FROM corpus",
    "text_reports": "SELECT DISTINCT trim(ccn) AS ccn, survey_date, f_tag, 'text of the tag' AS narrative FROM corpus WHERE regexp_full_match(trim(ccn), '[0-9]{6}') AND regexp_full_match(survey_date, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND regexp_full_match(f_tag, 'F[0-9]{3,4}')",
}
