"""Queries of the general data-quality operators over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.operators.orphans import corpus_orphans, orphan_report
from sievemark.operators.reject_rows import rejected_rows, valid_rows
from sievemark.operators.schema_drift import path_statistics, schema_changes, unified_records
from sievemark.plans import oracle_core
from sievemark.session import table

ORPHAN_TABLES = ("corpus", "provider_information", "tag_taxonomy", "health_deficiencies", "severity_grid")


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return corpus_orphans(spark, {t: table(spark, d, t) for t in ORPHAN_TABLES})


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("doc_id", "ref_table", "reason").distinct()


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_orphans(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_changes(table(spark, d, "archive_records")).where("depth = 0").select("file_name", "field_name", "change_kind").distinct()


def p4_changes(spark: SparkSession, d: str) -> DataFrame:
    """All changes, those inside objects and arrays too, with old names and types."""
    return schema_changes(table(spark, d, "archive_records"))


def p4_paths(spark: SparkSession, d: str) -> DataFrame:
    """How often each path occurs in a file, by raw type; only keys of the record (depth 0) and one level inside."""
    return path_statistics(table(spark, d, "archive_records"))


def p4_table(spark: SparkSession, d: str) -> DataFrame:
    out = unified_records(table(spark, d, "archive_records"))
    return out.withColumn("extra", F.to_json("extra")).withColumn("failed_casts", F.to_json("failed_casts"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return rejected_rows(table(spark, d, "raw_lines")).select("raw_id", "reason").distinct()


def p5_valid(spark: SparkSession, d: str) -> DataFrame:
    return valid_rows(table(spark, d, "raw_lines")).withColumn("survey_date", F.col("survey_date").cast("string"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p3_found, p3_report, p4_found, p4_changes, p4_paths, p4_table, p5_found, p5_valid)}
SQL: dict[str, str] = {"p3_found": oracle_core.P3_FOUND, "p3_report": oracle_core.P3_REPORT, "p4_paths": oracle_core.P4_PATHS, "p5_found": oracle_core.P5_FOUND, "p5_valid": oracle_core.P5_VALID}
