"""Disclosure control: what may be released, checks on it, and the bundle."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.contracts import FORBIDDEN_FIELDS, PERMITTED, RELEASE_FIELDS, ReleaseError, ReleasePolicy
from sievemark.functions.hashing import salted_hash
from sievemark.sources.writers import manifest_of, write_text

_SPARK = {"string": "string", "integer": "bigint", "boolean": "boolean", "number": "double"}


def prepare_annotations(frame: DataFrame, policy: ReleasePolicy | None = None) -> DataFrame:
    """Exactly the released fields; absent ones are null; the facility number hashed when the policy says so."""
    policy = policy or ReleasePolicy()
    cells = []
    for name, kind in RELEASE_FIELDS.items():
        c = F.col(name).cast(_SPARK[kind]) if name in frame.columns else F.lit(None).cast(_SPARK[kind])
        if name == "ccn" and policy.hash_ccn:
            c = salted_hash(c, policy.salt)
        cells.append(c.alias(name))
    return frame.select(*cells)


def validate_schema(df: DataFrame) -> DataFrame:
    """field_name, problem, n: extra, missing and forbidden fields, wrong types and values outside the vocabulary; an empty table is a problem itself."""
    spark = df.sparkSession
    rows = [(c, "forbidden" if c in FORBIDDEN_FIELDS else "extra", 1) for c in df.columns if c not in RELEASE_FIELDS]
    rows += [(c, "missing", 1) for c in RELEASE_FIELDS if c not in df.columns]
    kinds = {"string": ("string",), "integer": ("int", "bigint", "smallint"), "boolean": ("boolean",), "number": ("double", "float", "int", "bigint")}
    rows += [(f.name, "type", 1) for f in df.schema.fields if f.name in RELEASE_FIELDS and f.dataType.simpleString() not in kinds[RELEASE_FIELDS[f.name]]]
    checks = [(c, F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(*v))) for c, v in PERMITTED.items() if c in df.columns]
    counted = df.agg(F.count(F.lit(1)).alias("_n"), *[e.cast("bigint").alias(c) for c, e in checks])
    found = counted.select(F.explode(F.array(F.struct(F.lit("*").alias("field_name"), F.lit("empty").alias("problem"), F.when(F.col("_n") == 0, 1).otherwise(0).cast("bigint").alias("n")), *[F.struct(F.lit(c).alias("field_name"), F.lit("not permitted").alias("problem"), F.col(c).alias("n")) for c, _ in checks])).alias("x")).select("x.*").where("n > 0")
    fixed = spark.createDataFrame(rows, "field_name string, problem string, n bigint")
    return fixed.unionByName(found)


def scan_free_text(df: DataFrame, max_text: int = 64) -> DataFrame:
    """field_name, reason, n: text that is too long or reads like prose (three words)."""
    names = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    if not names:
        return df.sparkSession.createDataFrame([], "field_name string, reason string, n bigint")
    x = F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.when(F.length(F.col(c)) > max_text, "too_long").when(F.col(c).rlike(r"(?U)\S\s+\S+\s+\S"), "prose").alias("reason")) for c in names]))
    return df.select(x.alias("x")).where("x.reason is not null").groupBy("x.field_name", "x.reason").agg(F.count(F.lit(1)).alias("n"))


def k_anonymity(df: DataFrame, quasi: list[str], k: int = 10) -> DataFrame:
    """n_combinations, n_small (with under k rows) and rows_at_risk; null is a value."""
    g = df.groupBy(*quasi).agg(F.count(F.lit(1)).alias("c"))
    return g.agg(F.count(F.lit(1)).alias("n_combinations"), F.count_if(F.col("c") < k).alias("n_small"), F.coalesce(F.sum(F.when(F.col("c") < k, F.col("c"))), F.lit(0)).cast("bigint").alias("rows_at_risk"))


def suppress_small_cells(df: DataFrame, count: str = "n", k: int = 10, values: list[str] | None = None) -> DataFrame:
    """Counts under k (or null) become null with suppressed = true, and with them the named values; no row is dropped."""
    small = F.coalesce(F.col(count) < k, F.lit(True))
    hidden = [count, *(values or [])]
    return df.withColumn("suppressed", small).withColumns({c: F.when(~F.col("suppressed"), F.col(c)) for c in hidden})


def check_cells(df: DataFrame, count: str = "n", k: int = 10) -> DataFrame:
    """n_rows and n_offending cells that still show a count under k."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(count) < k).alias("n_offending"))


def offending_examples(df: DataFrame, condition: Column, order: list[str], limit: int = 20) -> DataFrame:
    return df.where(condition).orderBy(*order).limit(limit)


def facility_quarter(frame: DataFrame) -> DataFrame:
    return frame.where("ccn is not null and year is not null and quarter is not null").groupBy("ccn", "year", "quarter").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("technology_present", F.lit(False))).alias("n_technology"))


def disclosure_review(annotations: DataFrame, aggregates: DataFrame, policy: ReleasePolicy | None = None, count: str = "n") -> dict:
    """Cleared only when schema, both text scans and all cells are in order; k-anonymity is reported beside."""
    policy = policy or ReleasePolicy()
    checks = {
        "schema": [r.asDict() for r in validate_schema(annotations).collect()],
        "annotation_text": [r.asDict() for r in scan_free_text(annotations, policy.max_text).collect()],
        "aggregate_text": [r.asDict() for r in scan_free_text(aggregates, policy.max_text).collect()],
        "cells": [r.asDict() for r in check_cells(aggregates, count, policy.min_cell).collect() if r["n_offending"]],
    }
    quasi = [q for q in policy.quasi_identifiers if q in annotations.columns]
    return {"cleared": not any(checks.values()), "checks": checks, "k_anonymity": k_anonymity(annotations, quasi, policy.min_cell).first().asDict() if quasi else None}


DESCRIPTIONS = {
    "doc_id": "identifier of the narrative", "ccn": "facility number", "year": "year of the survey", "quarter": "quarter of the survey", "state": "state of the facility", "f_tag": "cited requirement", "scope_severity": "letter of the grid",
    "technology_present": "whether a technology is named", "technology_type": "kind of technology", "failure_role": "part it had in the failure", "harm_linked": "whether harm is linked to it", "evidence_span_start": "first character of the evidence", "evidence_span_end": "character after the evidence",
    "confidence": "confidence of the judgement", "model_id": "model that judged", "model_revision": "revision of the model", "prompt_hash": "digest of the prompt",
}
ROLES = {
    "absent": "needed but not there", "incidental": "named without a part in the failure", "juxtaposition_error": "the wrong person or entry, next to the right one", "malfunction": "did not work", "misconfiguration": "set wrongly", "not_responded_to": "worked, but no one reacted",
    "over_reliance": "took the place of care", "overcompleteness": "recorded more than was done", "workaround": "switched off or gone around", "none": "no technology",
}


def codebook(policy: ReleasePolicy | None = None) -> dict:
    """Name, type, description and permitted values of every field, what each role means, and the licence."""
    fields = [{"name": k, "type": v, "description": DESCRIPTIONS[k], "permitted": list(PERMITTED.get(k, ()))} for k, v in RELEASE_FIELDS.items()]
    return {"fields": fields, "roles": ROLES, "licence": (policy or ReleasePolicy()).licence}


def write_release(annotations: DataFrame, aggregates: DataFrame, folder: str, policy: ReleasePolicy | None = None, title: str = "Release") -> dict:
    """Review first; only a cleared release is written (JSON data, codebook, review, citation, manifest)."""
    policy = policy or ReleasePolicy()
    review = disclosure_review(annotations, aggregates, policy)
    if not review["cleared"]:
        raise ReleaseError("the disclosure review did not clear this release")
    spark, folder = annotations.sparkSession, folder.rstrip("/")
    annotations.write.mode("overwrite").json(f"{folder}/annotations")
    aggregates.write.mode("overwrite").json(f"{folder}/facility_quarter")
    as_json = lambda x: json.dumps(x, indent=1, sort_keys=True, default=str) + "\n"
    write_text(spark, f"{folder}/codebook.json", as_json(codebook(policy)))
    write_text(spark, f"{folder}/review.json", as_json(review))
    write_text(spark, f"{folder}/CITATION.cff", f"cff-version: 1.2.0\ntitle: {title}\nlicense: {policy.licence}\n")
    write_text(spark, f"{folder}/MANIFEST.json", as_json(manifest_of(spark, folder)))
    return review
