"""Readers for archives, structured files, labels, regulation text and taxonomies."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievemark.contracts import TAXONOMY_LEVELS, AnalysisError, CorpusError, ExtractionError

RECORD_FIELDS = ("ccn", "survey_date", "f_tag", "narrative", "scope_severity", "is_complaint", "state")
#: What begins a tag block and what heads a text report.
TAG_BLOCK = r"(?m)^\s*([FK]\s?\d{3,4})\b"
REPORT_HEADER = r"(?is)CCN[:\s]+(\d{6}).*?DATE[:\s]+(\d{4}-\d{2}-\d{2})"


def normalised(df: DataFrame) -> DataFrame:
    """Column names trimmed, lower-cased, blanks as underscores."""
    return df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])


def _records(df: DataFrame, column_map: dict[str, str] | None, ordinal: Column) -> DataFrame:
    for new, old in (column_map or {}).items():
        if old in df.columns and new != old:
            df = df.drop(new) if new in df.columns else df
            df = df.withColumnRenamed(old, new)
    have = [F.col(c).cast("string").alias(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in RECORD_FIELDS]
    return df.select(*have, ordinal.alias("offset"), "file_name")


def _in_file_order(df: DataFrame) -> DataFrame:
    """Rows with file_name and their 0-based place in the file.

    Ids of rows ascend inside a file split, and splits follow each other by their start. Rows are numbered
    inside their split, and the splits before it in the file are added up, so no task sees a whole file.
    """
    placed = df.select("*", F.col("_metadata.file_path").alias("file_name"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"))
    split = ["file_name", "_block"]
    numbered = placed.withColumn("_i", F.row_number().over(Window.partitionBy(*split).orderBy("_row")))
    earlier = Window.partitionBy("file_name").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # one row for each split
    sizes = placed.groupBy(*split).agg(F.count(F.lit(1)).alias("_n")).select(*split, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return numbered.join(sizes, split).withColumn("offset", (F.col("_before") + F.col("_i") - 1).cast("bigint")).drop("_block", "_row", "_i", "_before")


def read_csv_archive(spark: SparkSession, path: str, column_map: dict[str, str] | None = None) -> DataFrame:
    """CSV archive, all text; quotes doubled, line breaks inside quotes; offset is the row's place in its file."""
    raw = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").csv(path)
    placed = _in_file_order(raw)
    return _records(_rename(placed), column_map, F.col("offset"))


def _rename(df: DataFrame) -> DataFrame:
    keep = {"file_name", "offset"}
    return df.toDF(*[c if c in keep else c.strip().lower().replace(" ", "_") for c in df.columns])


def read_jsonl_archive(spark: SparkSession, path: str, column_map: dict[str, str] | None = None) -> DataFrame:
    """JSON lines; blank lines give no record but take a place; a line that is no JSON raises."""
    lines = _in_file_order(spark.read.text(path)).where(F.length(F.trim("value")) > 0)
    v = F.parse_json("value")  # raises on bad JSON
    keys = {**{c: c for c in RECORD_FIELDS}, **(column_map or {})}
    fields = [F.try_variant_get(v, "$." + old, "string").alias(new) for new, old in keys.items() if new in RECORD_FIELDS]
    return lines.select(*fields, "offset", "file_name")


def split_tag_blocks(text: Column) -> Column:
    """Array of (f_tag, narrative, place) of the tag blocks of a text; what precedes the first tag is dropped."""
    mark = "\u0001"
    parts = F.split(F.regexp_replace(text, TAG_BLOCK, mark + "$1" + mark), mark)
    n = F.floor((F.size(parts) - 1) / 2).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.upper(F.regexp_replace(F.get(parts, i * 2 + 1), r"\s", "")).alias("f_tag"), F.regexp_replace(F.get(parts, i * 2 + 2), r"(?U)^\s+|\s+$", "").alias("narrative"), i.alias("place")))).otherwise(F.array().cast("array<struct<f_tag:string,narrative:string,place:int>>"))


def read_text_reports(spark: SparkSession, path: str, column_map: dict[str, str] | None = None, header: str = REPORT_HEADER) -> DataFrame:
    """Whole reports with a CCN and DATE header and one record for each tag block; a report without header raises."""
    raw = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file_name"))
    ccn, day = F.regexp_extract("value", header, 1), F.regexp_extract("value", header, 2)
    blocks = split_tag_blocks(F.col("value"))
    # the check sits in the exploded value: a report without tags leaves no row that could raise later
    guarded = F.when(ccn == "", F.raise_error(F.concat(F.lit("no report header in "), "file_name"))).otherwise(blocks)
    checked = raw.select(ccn.alias("ccn"), day.alias("survey_date"), "file_name", F.explode(guarded).alias("b"))
    none = F.lit(None).cast("string")
    return checked.select("ccn", "survey_date", F.col("b.f_tag").alias("f_tag"), F.col("b.narrative").alias("narrative"), none.alias("scope_severity"), none.alias("is_complaint"), none.alias("state"), F.col("b.place").cast("bigint").alias("offset"), "file_name")


PARSERS: dict[str, Callable[..., DataFrame]] = {"csv": read_csv_archive, "jsonl": read_jsonl_archive, "text": read_text_reports}


def read_archives(spark: SparkSession, path: str, fmt: str = "csv", column_map: dict[str, str] | None = None) -> DataFrame:
    if fmt not in PARSERS:
        raise CorpusError(f"unknown archive format {fmt}; known: {', '.join(sorted(PARSERS))}")
    return PARSERS[fmt](spark, path, column_map)


def read_structured(spark: SparkSession, path: str) -> DataFrame:
    """A structured CSV file, all text, names normalised."""
    return normalised(spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path))


def read_annotations(spark: SparkSession, path: str) -> DataFrame | None:
    """Coders' JSON files as one long table; the coder's number follows the sorted file names. None when there is no file."""
    try:
        raw = spark.read.option("multiLine", True).json(path).withColumn("_file", F.col("_metadata.file_path"))
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise
    files = raw.select("_file").distinct().withColumn("annotator", F.dense_rank().over(Window.orderBy("_file")) - 1)
    few = files.limit(100_001).count() <= 100_000
    return raw.join(F.broadcast(files) if few else files, "_file").drop("_file")


def read_regulation(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a regulation text with their number: line_no, line. Bad bytes are replaced."""
    return _in_file_order(spark.read.text(path)).select(F.col("offset").alias("line_no"), F.col("value").alias("line"))


#: Levels used where no taxonomy file is given.
ANCHOR_LEVELS = {"F919": "full", "F700": "full", "F909": "full", "F908": "full", "F689": "partial", "F604": "partial", "F842": "partial"}


def taxonomy_rows(content: dict | None) -> list[tuple[str, str, str | None, str | None, str | None]]:
    """(f_tag, level, justification, regulation, method) of a taxonomy as tag -> entry, tag -> level or tag -> bool; keys that begin with ``_`` are skipped."""
    if content is None:
        return [(k, v, None, None, "anchor") for k, v in ANCHOR_LEVELS.items()]
    rows = []
    for tag, entry in content.items():
        if tag.startswith("_"):
            continue
        if isinstance(entry, bool):
            row = ("full" if entry else "none", None, None, None)
        elif isinstance(entry, dict):
            row = (entry.get("names_technology"), entry.get("justification"), entry.get("regulation"), entry.get("method"))
        else:
            row = (entry, None, None, None)
        if row[0] not in TAXONOMY_LEVELS:
            raise AnalysisError(f"tag {tag}: unknown level {row[0]!r}")
        rows.append((tag, *row))
    return rows


def read_taxonomy(spark: SparkSession, path: str | None) -> DataFrame:
    content = json.loads(Path(path).read_text(encoding="utf-8")) if path and Path(path).exists() else None
    return spark.createDataFrame(taxonomy_rows(content), "f_tag string, level string, justification string, regulation string, method string")


def newest(paths: list[str]) -> str:
    """The last by name."""
    if not paths:
        raise ExtractionError("no file")
    return sorted(paths)[-1]


def load_prompt(folder: str, variant: str = "v1", name: str = "prompt_v1.txt") -> str:
    path = Path(folder) / name.replace("v1", variant)
    if not path.exists():
        raise ExtractionError(f"no prompt {path}")
    return path.read_text(encoding="utf-8")


def changed_files(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Files that are new or differ from a manifest (file_name, sha256): file_name, sha256, n_bytes."""
    now = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("n_bytes"))
    return now.join(manifest.select("file_name", "sha256"), ["file_name", "sha256"], "left_anti")
