"""The corpus: one row for each cited deficiency, linked to the structured tables and audited."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievemark.contracts import CORPUS_SCHEMA, CorpusError
from sievemark.functions.hashing import stable_doc_id
from sievemark.functions.keys import blank_to_null, day_key, facility_key, tag_key
from sievemark.functions.severity import decompose
from sievemark.functions.text import count_tokens, strip_boilerplate

REQUIRED = ("ccn", "survey_date", "f_tag", "narrative")


def parsed_day(c: Column) -> Column:
    return F.coalesce(F.to_date(F.try_to_timestamp(c, F.lit("yyyy-MM-dd"))), F.to_date(F.try_to_timestamp(c, F.lit("M/d/yyyy"))))


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """First row of each key by an explicit order.

    A minimum over structs, so partial results are merged before the shuffle and a key with a third of
    the rows is no sort of a third of the rows.
    """
    rest = [c for c in df.columns if c not in keys]
    ranked = [c if isinstance(c, Column) else F.col(c) for c in order]
    best = F.min(F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(ranked)], *rest)).alias("_s")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col("_s")[c].alias(c) for c in rest])


def prepare_narratives(records: DataFrame, min_tokens: int = 40, drop_boilerplate: bool = True) -> DataFrame:
    """Required fields, boilerplate, token count, canonical keys, stable id. Rows shorter than ``min_tokens`` are left out."""
    r = records
    for c in REQUIRED:
        r = r.where(F.col(c).isNotNull() & (F.col(c) != ""))
    text = strip_boilerplate(F.col("narrative")) if drop_boilerplate else F.regexp_replace("narrative", r"(?U)^\s+|\s+$", "")
    r = r.withColumn("narrative", text).withColumn("n_tokens", count_tokens(F.col("narrative")).cast("bigint")).where(F.col("n_tokens") >= min_tokens)
    ccn, day, tag = F.upper(F.trim("ccn")), F.trim("survey_date"), F.upper(F.regexp_replace("f_tag", r"\s", ""))
    return r.select(stable_doc_id(ccn, day, tag, F.col("offset")).alias("doc_id"), ccn.alias("ccn"), day.alias("survey_date"), tag.alias("f_tag"), "narrative", "n_tokens", "scope_severity", "is_complaint", "state")


def dropped_short(records: DataFrame, min_tokens: int = 40) -> DataFrame:
    """How many complete rows fall under the token minimum: n_complete, dropped_short."""
    complete = records.where(" and ".join(f"{c} is not null and {c} <> ''" for c in REQUIRED))
    n = count_tokens(strip_boilerplate(F.col("narrative")))
    return complete.agg(F.count(F.lit(1)).alias("n_complete"), F.count_if(n < min_tokens).alias("dropped_short"))


def link_citations(narratives: DataFrame, citations: DataFrame, order: list[Column | str] | None = None) -> DataFrame:
    """Left join to the structured citations by canonical facility, day and tag; of several the first by ``order``.

    Adds scope_severity_structured, deficiency_category, standard_deficiency and joined (a true hit, D4).
    """
    c = citations.select(
        facility_key(F.col("cms_certification_number_ccn")).alias("k_ccn"), day_key(F.col("survey_date")).alias("k_day"), tag_key(F.col("deficiency_tag_number")).alias("k_tag"),
        F.col("scope_severity").alias("scope_severity_structured"), "deficiency_category", "standard_deficiency", *[x for x in ("loaded_at",) if x in citations.columns],
    ).where("k_ccn is not null and k_day is not null and k_tag is not null")
    first = keep_first(c, ["k_ccn", "k_day", "k_tag"], order or [*[x for x in ("loaded_at",) if x in c.columns], F.coalesce("scope_severity_structured", F.lit("~")), F.coalesce("deficiency_category", F.lit("~"))])
    first = first.select("k_ccn", "k_day", "k_tag", "scope_severity_structured", "deficiency_category", "standard_deficiency", F.lit(True).alias("joined"))
    keyed = narratives.withColumn("k_ccn", facility_key(F.col("ccn"))).withColumn("k_day", day_key(F.col("survey_date"))).withColumn("k_tag", tag_key(F.col("f_tag")))
    return keyed.join(first, ["k_ccn", "k_day", "k_tag"], "left").withColumn("joined", F.coalesce("joined", F.lit(False))).drop("k_ccn", "k_day", "k_tag")


def link_providers(corpus: DataFrame, providers: DataFrame) -> DataFrame:
    """Left join to the latest version of each facility: ownership_type, certified_beds and the facility's state where the row has none."""
    p = providers.select(
        facility_key(F.col("cms_certification_number_ccn")).alias("k_ccn"), F.col("ownership_type").alias("p_ownership"), F.expr("try_cast(regexp_extract(number_of_certified_beds, '^\\\\s*(\\\\d+)\\\\s*$', 1) as bigint)").alias("p_beds"), F.col("state").alias("p_state"),
        *[x for x in ("loaded_at",) if x in providers.columns],
    ).where("k_ccn is not null")
    order = [-F.unix_micros(F.col("loaded_at").cast("timestamp"))] if "loaded_at" in p.columns else []
    first = keep_first(p, ["k_ccn"], [*order, F.coalesce("p_ownership", F.lit("~")), F.coalesce("p_beds", F.lit(-1).cast("bigint")), F.coalesce("p_state", F.lit("~"))]).drop("loaded_at")
    out = corpus.drop("ownership_type", "certified_beds").withColumn("k_ccn", facility_key(F.col("ccn"))).join(first, "k_ccn", "left")
    return out.withColumn("state", F.coalesce("state", "p_state")).withColumnRenamed("p_ownership", "ownership_type").withColumnRenamed("p_beds", "certified_beds").drop("k_ccn", "p_state")


def link_communities(facilities: DataFrame, crosswalk: DataFrame, communities: DataFrame, limit: int = 1_000_000) -> DataFrame:
    """Facilities with the covariates of their county: by county_ssa over the crosswalk (county_ssa, county_fips) to ``communities`` (county_fips, ...).

    Codes are compared as digits, zeros restored to five. Of repeated codes the first by all columns counts,
    so no facility is multiplied; facilities without a match keep nulls. Both tables are broadcast while they
    have at most ``limit`` rows.
    """
    code = lambda c: F.lpad(F.regexp_replace(F.col(c).cast("string"), r"\D", ""), 5, "0")
    over = keep_first(crosswalk.select(code("county_ssa").alias("_ssa"), code("county_fips").alias("county_fips")).where("_ssa is not null"), ["_ssa"], ["county_fips"])
    named = [c for c in communities.columns if c != "county_fips"]
    place = keep_first(communities.select(code("county_fips").alias("county_fips"), *named).where("county_fips is not null"), ["county_fips"], [F.col(c).cast("string") for c in named])
    held = lambda df: F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
    return facilities.withColumn("_ssa", code("county_ssa")).join(held(over), "_ssa", "left").drop("_ssa").join(held(place), "county_fips", "left")


def enforce_schema(df: DataFrame) -> DataFrame:
    """Exactly the corpus columns in order; what cannot be cast becomes null."""
    have = set(df.columns)
    cells = []
    for f in CORPUS_SCHEMA.fields:
        if f.name not in have:
            cells.append(F.lit(None).cast(f.dataType).alias(f.name))
        else:
            cells.append(F.col(f.name).try_cast(f.dataType).alias(f.name))
    return df.select(*cells)


def cast_failures(df: DataFrame) -> DataFrame:
    """column and n_failed: values of each corpus column that are there but cannot take its type (D14). One aggregation."""
    fields = [f for f in CORPUS_SCHEMA.fields if f.name in df.columns]
    counts = df.agg(*[F.count_if(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull()).alias(f.name) for f in fields])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(f.name).alias("column"), F.col(f.name).alias("n_failed")) for f in fields])).alias("x")).select("x.*")


def build_corpus(records: DataFrame, citations: DataFrame | None = None, providers: DataFrame | None = None, min_tokens: int = 40, drop_boilerplate: bool = True) -> DataFrame:
    """Records to corpus as one lazy plan with two left joins; check ids with ``assert_unique``."""
    c = prepare_narratives(records, min_tokens, drop_boilerplate)
    if citations is not None:
        c = link_citations(c, citations).withColumn("scope_severity", F.coalesce("scope_severity", "scope_severity_structured"))
    if providers is not None:
        c = link_providers(c, providers)
    day = parsed_day(F.col("survey_date"))
    c = c.withColumn("year", F.year(day).cast("bigint")).withColumn("quarter", F.quarter(day).cast("bigint")).withColumns(decompose(F.col("scope_severity")))
    return enforce_schema(c)


def duplicate_ids(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """n_rows, n_ids and n_duplicates (rows beyond the first of each id; null is an id)."""
    per = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_rows"), F.count(F.lit(1)).alias("n_ids"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("n_duplicates"))


def assert_unique(df: DataFrame, key: str = "doc_id") -> DataFrame:
    n = duplicate_ids(df, key).first()["n_duplicates"]
    if n:
        raise CorpusError(f"{n} rows repeat a {key}")
    return df


def coverage_audit(linked: DataFrame) -> DataFrame:
    """n, matched (rows with a severity letter, as the compatible measure), joined (true hits) and their rates."""
    return linked.agg(F.count(F.lit(1)).alias("n"), F.count("scope_severity").alias("n_matched"), F.count_if("joined").alias("n_joined")).select(
        "n", "n_matched", "n_joined", F.round(F.try_divide("n_matched", "n"), 4).alias("match_rate"), F.round(F.try_divide("n_joined", "n"), 4).alias("join_rate")
    )


def coverage_by_year(linked: DataFrame) -> DataFrame:
    return linked.where("year is not null").groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("scope_severity").isNotNull().cast("double")), 4).alias("match_rate"), F.round(F.avg(F.col("joined").cast("double")), 4).alias("join_rate"))


def analysis_frame(corpus: DataFrame, extracted: DataFrame, on_parse_failure: str = "false") -> DataFrame:
    """Corpus joined to one judgement for each narrative (D1), with survey_id (D2).

    Of several judgements the one that parsed counts, then the most confident. ``on_parse_failure``:
    ``false`` takes an unusable judgement as no technology, ``exclude`` leaves the row out (D3).
    """
    cols = ["technology_type", "failure_role", "technology_present", "harm_linked"]
    best = extracted.groupBy("doc_id").agg(F.max(F.struct(F.coalesce("parse_ok", F.lit(False)).alias("parse_ok"), F.coalesce("confidence", F.lit(-1.0)).alias("confidence"), *cols)).alias("j"))
    f = corpus.join(best, "doc_id").select("*", "j.*").drop("j")
    f = f.withColumn("confidence", F.when(F.col("confidence") >= 0, F.col("confidence"))).withColumn("survey_id", F.concat_ws("~", facility_key(F.col("ccn")), day_key(F.col("survey_date"))))
    if on_parse_failure == "exclude":
        f = f.where("parse_ok")
    return f.withColumn("technology_present", F.coalesce("technology_present", F.lit(False)))


def canonical_keys(df: DataFrame) -> DataFrame:
    """Facility, tag and state in their one form (``facility_key``, ``tag_key``, state trimmed and upper-cased), where the columns are there."""
    forms = {"ccn": facility_key(F.col("ccn")), "f_tag": tag_key(F.col("f_tag")), "state": F.upper(blank_to_null(F.col("state")))}
    return df.withColumns({k: v for k, v in forms.items() if k in df.columns})


def rank_in_file(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """0-based ordinal by an explicit order, for sources without one."""
    return df.withColumn("offset", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
