"""Queries of the measurement and analysis operators over the whole test tables, with the SQL each is held against.

Floating results are rounded to six digits on both sides. A query without SQL is iterative, random or
uses a function no SQL engine has; its operator is tested against brute force or closed forms.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.contracts import FAILURE_ROLES, TECHNOLOGY_TYPES, AnalysisError, Config
from sievemark.functions import diffusion
from sievemark.functions.hashing import stable_doc_id
from sievemark.functions.keys import facility_key, tag_key
from sievemark.functions.severity import decompose, grid_letter
from sievemark.functions.text import BOILERPLATE_MARKERS, GUIDANCE_WORDS, REFUSAL, count_tokens, locate_span, looks_like_refusal, requirement_text, strip_boilerplate
from sievemark.operators import agreement, corpus, forecast, judgements, release, reliability, stats, stratified, taxonomy, trends
from sievemark.plans.gate import gate_table, gate_verdict
from sievemark.plans.validation import validate_measurement
from sievemark.session import table
from sievemark.sources.readers import split_tag_blocks
from sievemark.streaming.prevalence import windowed_share

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(df: DataFrame) -> DataFrame:
    """Doubles rounded to six digits, without negative zeros."""
    return df.select(*[(F.round(F.col(f"`{f.name}`"), 6) + 0.0).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f"`{f.name}`") for f in df.schema.fields])


# --- pieces of SQL -----------------------------------------------------------------------------------


def _tag(x: str) -> str:
    t = f"upper(regexp_replace({x}, '\\s', '', 'g'))"
    return f"(CASE WHEN regexp_matches({t}, '^[A-Z]?[0-9]+$') THEN coalesce(nullif(regexp_extract({t}, '^([A-Z]?)', 1), ''), 'F') || regexp_extract({t}, '^[A-Z]?0*([0-9]+)$', 1) ELSE nullif({t}, '') END)"


def _ccn(x: str) -> str:
    return f"(CASE WHEN trim({x}) <> '' THEN lpad(upper(trim({x})), greatest(6, length(trim({x})))::INT, '0') END)"


def _day(x: str) -> str:
    t = f"trim({x})"
    return f"(CASE WHEN regexp_matches({t}, '^[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}$') THEN split_part({t}, '/', 3) || '-' || lpad(split_part({t}, '/', 1), 2, '0') || '-' || lpad(split_part({t}, '/', 2), 2, '0') ELSE nullif({t}, '') END)"


_FRAME = f"""
levels AS (SELECT {_tag('f_tag')} AS tag, min(names_technology) AS level FROM tag_taxonomy GROUP BY 1),
best AS (
  SELECT * FROM (SELECT doc_id, coalesce(parse_ok, false) AS parse_ok, technology_present AS tp, technology_type, failure_role,
    row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(parse_ok, false) DESC, coalesce(confidence, -1) DESC, technology_type DESC NULLS LAST, failure_role DESC NULLS LAST, technology_present DESC NULLS LAST, harm_linked DESC NULLS LAST) AS rn
    FROM extracted) WHERE rn = 1),
frame AS (
  SELECT c.doc_id, {_ccn('c.ccn')} AS ccn, c.year, c.quarter, nullif(upper(trim(c.state)), '') AS state, c.severity_level, c.scope_severity, c.n_tokens, c.certified_beds, {_tag('c.f_tag')} AS tag, {_ccn('c.ccn')} || '~' || {_day('c.survey_date')} AS survey_id,
         coalesce(b.tp, false) AS tech, b.technology_type, b.failure_role, coalesce(l.level, 'none') AS level
  FROM corpus c JOIN best b ON b.doc_id = c.doc_id LEFT JOIN levels l ON l.tag = {_tag('c.f_tag')})"""

_GOLD = """
votes AS (SELECT * FROM (SELECT doc_id, annotator, technology_present AS tp, lower(trim(failure_role)) AS role,
    row_number() OVER (PARTITION BY doc_id, annotator ORDER BY labelled_at DESC NULLS LAST, technology_present DESC NULLS LAST, lower(trim(failure_role)) DESC NULLS LAST) AS rn FROM annotations) WHERE rn = 1),
gold AS (SELECT doc_id, avg(tp::INT) > 0.5 AS gold FROM votes WHERE tp IS NOT NULL GROUP BY 1),
model AS (SELECT doc_id, bool_or(coalesce(parse_ok, false) AND coalesce(technology_present, false)) AS pred, min(CASE WHEN parse_ok THEN failure_role END) AS role FROM extracted GROUP BY 1)"""


def levels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tag_taxonomy").groupBy(tag_key(F.col("f_tag")).alias("f_tag")).agg(F.min("names_technology").alias("level"))


def frame(spark: SparkSession, d: str) -> DataFrame:
    f = corpus.canonical_keys(corpus.analysis_frame(table(spark, d, "corpus"), table(spark, d, "extracted")))
    return taxonomy.with_level(f, levels(spark, d))


def votes(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "annotations").withColumn("failure_role", F.lower(F.trim("failure_role")))
    return a.groupBy("doc_id", "annotator").agg(F.max(F.struct("labelled_at", "technology_present", "failure_role")).alias("v")).select("doc_id", "annotator", "v.technology_present", "v.failure_role")


def gold(spark: SparkSession, d: str) -> DataFrame:
    return votes(spark, d).where("technology_present is not null").groupBy("doc_id").agg((F.avg(F.col("technology_present").cast("int")) > 0.5).alias("gold"))


def model(spark: SparkSession, d: str) -> DataFrame:
    ok = F.coalesce("parse_ok", F.lit(False))
    return table(spark, d, "extracted").groupBy("doc_id").agg(F.bool_or(ok & F.coalesce("technology_present", F.lit(False))).alias("pred"), F.min(F.when(ok, F.col("failure_role"))).alias("role"))


def codes(spark: SparkSession, d: str, column: str) -> DataFrame:
    return votes(spark, d).select(F.col("doc_id").alias("unit"), F.col("annotator").alias("coder"), F.col(column).alias("value")).where("value is not null")


# --- corpus ------------------------------------------------------------------------------------------


@query("""SELECT doc_id, CASE WHEN i BETWEEN 0 AND 11 THEN (i // 3 + 1)::DOUBLE END AS severity_level, CASE WHEN i BETWEEN 0 AND 11 THEN (i % 3 + 1)::DOUBLE END AS scope_level,
 coalesce(i BETWEEN 6 AND 11, false) AS actual_harm, coalesce(i BETWEEN 9 AND 11, false) AS immediate_jeopardy
FROM (SELECT doc_id, ascii(nullif(substr(upper(trim(scope_severity)), 1, 1), '')) - 65 AS i FROM corpus)""")
def severity_decompose(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "corpus").select("doc_id", *[c.alias(k) for k, c in decompose(F.col("scope_severity")).items()])


def _linked(spark: SparkSession, d: str) -> DataFrame:
    return corpus.link_citations(table(spark, d, "corpus"), table(spark, d, "health_deficiencies"))


_LINKED = f"""
hits AS (SELECT * FROM (SELECT {_ccn('cms_certification_number_ccn')} AS k1, {_day('survey_date')} AS k2, {_tag('deficiency_tag_number')} AS k3, scope_severity, deficiency_category,
  row_number() OVER (PARTITION BY {_ccn('cms_certification_number_ccn')}, {_day('survey_date')}, {_tag('deficiency_tag_number')} ORDER BY loaded_at, coalesce(scope_severity, '~'), coalesce(deficiency_category, '~')) AS rn FROM health_deficiencies) WHERE rn = 1),
linked AS (SELECT c.doc_id, c.year, c.scope_severity, h.scope_severity AS scope_severity_structured, h.deficiency_category, h.k1 IS NOT NULL AS joined
  FROM corpus c LEFT JOIN hits h ON h.k1 = {_ccn('c.ccn')} AND h.k2 = {_day('c.survey_date')} AND h.k3 = {_tag('c.f_tag')})"""


@query(f"WITH {_LINKED} SELECT doc_id, coalesce(scope_severity, scope_severity_structured) AS scope_severity, deficiency_category, joined FROM linked")
def corpus_left_join(spark, d):  # noqa: ANN001, ANN201
    return _linked(spark, d).select("doc_id", F.coalesce("scope_severity", "scope_severity_structured").alias("scope_severity"), "deficiency_category", "joined")


@query(f"""WITH p AS (SELECT * FROM (SELECT {_ccn('cms_certification_number_ccn')} AS k, ownership_type, TRY_CAST(regexp_extract(number_of_certified_beds, '^\\s*([0-9]+)\\s*$', 1) AS BIGINT) AS beds, state,
  row_number() OVER (PARTITION BY {_ccn('cms_certification_number_ccn')} ORDER BY loaded_at DESC, coalesce(ownership_type, '~'), coalesce(TRY_CAST(regexp_extract(number_of_certified_beds, '^\\s*([0-9]+)\\s*$', 1) AS BIGINT), -1), coalesce(state, '~')) AS rn FROM provider_information) WHERE rn = 1)
SELECT c.doc_id, coalesce(c.state, p.state) AS state, p.ownership_type, p.beds AS certified_beds FROM corpus c LEFT JOIN p ON p.k = {_ccn('c.ccn')}""")
def provider_covariates(spark, d):  # noqa: ANN001, ANN201
    return corpus.link_providers(table(spark, d, "corpus"), table(spark, d, "provider_information")).select("doc_id", "state", "ownership_type", "certified_beds")


@query(f"WITH {_LINKED} SELECT count(*)::BIGINT AS n, count(scope_severity)::BIGINT AS n_matched, count_if(joined)::BIGINT AS n_joined, round(count(scope_severity) / count(*), 4) AS match_rate, round(count_if(joined) / count(*), 4) AS join_rate FROM linked")
def coverage_audit(spark, d):  # noqa: ANN001, ANN201
    return corpus.coverage_audit(_linked(spark, d))


@query(f"WITH {_LINKED} SELECT year, count(*)::BIGINT AS n, round(avg((scope_severity IS NOT NULL)::INT), 4) AS match_rate, round(avg(joined::INT), 4) AS join_rate FROM linked WHERE year IS NOT NULL GROUP BY year")
def coverage_by_year(spark, d):  # noqa: ANN001, ANN201
    return corpus.coverage_by_year(_linked(spark, d))


@query("SELECT count(*)::BIGINT AS n_rows, count(DISTINCT doc_id)::BIGINT AS n_ids, (count(*) - count(DISTINCT doc_id))::BIGINT AS n_duplicates FROM extracted")
def duplicate_ids(spark, d):  # noqa: ANN001, ANN201
    return corpus.duplicate_ids(table(spark, d, "extracted"))


@query("SELECT doc_id, year FROM corpus c WHERE NOT EXISTS (SELECT 1 FROM annotations a WHERE a.doc_id = c.doc_id)")
def top_up_anti_join(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "corpus").select("doc_id", "year").join(table(spark, d, "annotations").select("doc_id"), "doc_id", "left_anti")


@query("SELECT n_sample, n_overlap, round(n_overlap / n_sample, 6) AS overlap FROM (SELECT count(*)::BIGINT AS n_sample, count_if(doc_id IN (SELECT doc_id FROM annotations))::BIGINT AS n_overlap FROM (SELECT DISTINCT doc_id FROM corpus))")
def gold_overlap(spark, d):  # noqa: ANN001, ANN201
    return r6(agreement.gold_overlap(table(spark, d, "corpus"), table(spark, d, "annotations")))


@query("SELECT c.doc_id, coalesce(g.p, false) AS gold_present, coalesce(g.r, 'none') AS gold_role FROM corpus c LEFT JOIN (SELECT doc_id, bool_or(technology_present) AS p, max(failure_role) AS r FROM annotations WHERE annotator = (SELECT min(annotator) FROM annotations) GROUP BY 1) g ON g.doc_id = c.doc_id")
def gold_aligned(spark, d):  # noqa: ANN001, ANN201
    """The labels of the first coder, by whom gold is defined, beside every narrative."""
    a = table(spark, d, "annotations")
    return agreement.gold_aligned(table(spark, d, "corpus"), a, a.agg(F.min("annotator")).first()[0])


@query()
def stable_ids(spark, d):  # noqa: ANN001, ANN201
    c = table(spark, d, "corpus")
    return c.select("doc_id", stable_doc_id(F.col("ccn"), F.col("survey_date"), F.col("f_tag"), F.lit(0)).alias("stable_id"))


@query("SELECT doc_id, sha256(narrative) AS digest FROM corpus")
def content_digest(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "corpus").select("doc_id", F.sha2("narrative", 256).alias("digest"))


@query()
def stratified_weights(spark, d):  # noqa: ANN001, ANN201
    s = stratified.stratified_sample(table(spark, d, "corpus"), 1200, 20260101, {4.0: 60, 3.0: 100})
    return s.select("doc_id", "severity_level", "year", "sampling_weight")


_SIZES = "sizes AS (SELECT coalesce(severity_level, -1) AS level, count(*)::BIGINT AS n FROM (SELECT doc_id, min(coalesce(severity_level, -1)) AS severity_level FROM corpus GROUP BY 1) GROUP BY 1), goal AS (SELECT level, n, least(1200, sum(n) OVER ()) * n / sum(n) OVER () AS g, least(1200, sum(n) OVER ()) AS total FROM sizes)"


@query(f"WITH {_SIZES}, low AS (SELECT *, floor(g + 1e-9) AS f, row_number() OVER (ORDER BY g - floor(g + 1e-9) DESC, level) AS place FROM goal) SELECT level, (f + (place <= total - sum(f) OVER ())::INT)::BIGINT AS quota FROM low")
def level_allocation(spark, d):  # noqa: ANN001, ANN201
    """Rows of each severity level in a sample of 1,200, by largest remainder."""
    ids = table(spark, d, "corpus").groupBy("doc_id").agg(F.min(F.coalesce("severity_level", F.lit(-1.0))).alias("level"))
    sizes = {r[0]: r[1] for r in ids.groupBy("level").agg(F.count(F.lit(1))).collect()}
    return spark.createDataFrame(list(stratified.level_quotas(sizes, 1200, {}).items()), "level double, quota bigint")


# --- text --------------------------------------------------------------------------------------------


@query("SELECT doc_id, len(regexp_extract_all(narrative, '\\S+'))::BIGINT AS n_tokens FROM corpus WHERE len(regexp_extract_all(narrative, '\\S+')) >= 40")
def token_counts(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "corpus").select("doc_id", count_tokens(F.col("narrative")).cast("bigint").alias("n_tokens")).where("n_tokens >= 40")


def _rfind(m: str) -> str:
    return f"(CASE WHEN contains(lower(narrative), '{m}') THEN length(narrative) - strpos(reverse(lower(narrative)), reverse('{m}')) + 1 END)"


@query("SELECT doc_id, CASE WHEN cut IS NULL THEN regexp_replace(narrative, '^\\s+|\\s+$', '', 'g') ELSE regexp_replace(substr(narrative, cut + 1), '^[ :,;\\-\\n\\t]+|[ :,;\\-\\n\\t]+$', '', 'g') END AS body FROM (SELECT doc_id, narrative, greatest(" + ", ".join(_rfind(m) for m in BOILERPLATE_MARKERS) + ") AS cut FROM corpus)")
def boilerplate_strip(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "corpus").select("doc_id", strip_boilerplate(F.col("narrative")).alias("body"))


@query(r"""WITH t AS (SELECT doc_id, 'preamble' || chr(10) || f_tag || ' ' || coalesce(narrative, '') || chr(10) || 'F 689 again' || chr(10) AS text FROM corpus WHERE f_tag IS NOT NULL),
b AS (SELECT doc_id, regexp_extract_all(text, '(?m)^\s*([FK]\s?\d{3,4})\b', 1) AS tags, regexp_split_to_array(text, '(?m)^\s*[FK]\s?\d{3,4}\b') AS parts FROM t)
SELECT doc_id, upper(regexp_replace(tags[i], '\s', '', 'g')) AS f_tag, (i - 1)::INT AS place, length(regexp_replace(parts[i + 1], '^\s+|\s+$', '', 'g')) AS n_chars FROM (SELECT *, unnest(range(1, len(tags) + 1)) AS i FROM b)""".replace("\\\\", "\\"))
def report_tag_blocks(spark, d):  # noqa: ANN001, ANN201
    text = F.concat(F.lit("preamble\n"), F.col("f_tag"), F.lit(" "), F.coalesce("narrative", F.lit("")), F.lit("\nF 689 again\n"))
    return table(spark, d, "corpus").where("f_tag is not null").select("doc_id", F.explode(split_tag_blocks(text)).alias("b")).select("doc_id", "b.f_tag", "b.place", F.length("b.narrative").alias("n_chars"))


def _requirement(x: str) -> str:
    body = f"regexp_replace({x}, '\\(Rev\\.[^)]*\\)', ' ', 'g')"
    blanks = "[\\s\\x0B\\x{85}\\x{A0}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{3000}]+"
    own = f"CASE WHEN regexp_matches({body}, '{_GUIDANCE}') THEN regexp_extract({body}, '(?s)^(.*?){_GUIDANCE}', 1) ELSE substr({body}, 1, 900) END"
    return f"substr(regexp_replace(regexp_replace({own}, '{blanks}', ' ', 'g'), '^ | $', '', 'g'), 1, 900)"


_GUIDANCE = "\\b(?:" + "|".join(GUIDANCE_WORDS) + ")\\b"
_FULL = "[x FOR x IN [" + ", ".join(f"CASE WHEN regexp_matches(req, '(?i){p}') THEN '{k}' END" for k, p in taxonomy.FULL_PATTERNS) + "] IF x IS NOT NULL]"
_HITS = "list_sort([x FOR x IN [" + ", ".join(f"{{'c': -len(regexp_extract_all(block, '(?i){p}')), 'i': {i}, 'label': '{k}'}}" for i, (k, p) in enumerate(taxonomy.PARTIAL_PATTERNS)) + "] IF x.c < 0])"
_OWN_LEVEL = "CASE f_tag " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in taxonomy.CURATED.items()) + " END"


@query(f"""WITH p AS (SELECT doc_id AS book, regexp_split_to_array('F' || lpad((doc_id % 1000)::VARCHAR, 3, '0') || chr(10) || text, '\\r?\\n') AS parts FROM documents WHERE text IS NOT NULL),
l AS (SELECT book, i, parts[i] AS line, nullif(regexp_extract(parts[i], '^\\s*(F\\d{{3}})\\s*$', 1), '') AS head FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM p)),
t AS (SELECT *, last_value(head IGNORE NULLS) OVER (PARTITION BY book ORDER BY i ROWS UNBOUNDED PRECEDING) AS f_tag FROM l),
b AS (SELECT book, f_tag, string_agg(line, chr(10) ORDER BY i) AS block FROM t WHERE head IS NULL AND f_tag IS NOT NULL GROUP BY ALL),
r AS (SELECT *, {_requirement('block')} AS req FROM b), c AS (SELECT book, f_tag, {_OWN_LEVEL} AS own, {_FULL} AS full_, {_HITS} AS hits FROM r)
SELECT book, f_tag, coalesce(own, CASE WHEN len(full_) > 0 THEN 'full' WHEN len(hits) > 0 THEN 'partial' ELSE 'none' END) AS level, CASE WHEN own IS NULL THEN 'rule' ELSE 'curated' END AS method,
CASE WHEN own IS NOT NULL THEN 'decided by hand' WHEN len(full_) > 0 THEN array_to_string(full_, '; ') WHEN len(hits) > 0 THEN array_to_string([x.label || ' (' || (-x.c) || ')' FOR x IN hits[1:4]], ', ') ELSE 'no technology word' END AS justification FROM c""")
def regulation_levels(spark, d):  # noqa: ANN001, ANN201
    lines = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("book"), F.posexplode(F.split(F.concat(F.lit("F"), F.lpad((F.col("doc_id") % 1000).cast("string"), 3, "0"), F.lit("\n"), F.col("text")), "\r?\n")).alias("line_no", "line"))
    return taxonomy.classify_blocks(taxonomy.tag_blocks(lines)).select("book", "f_tag", "level", "method", "justification")


@query(f"SELECT doc_id, {_requirement('text')} AS requirement FROM documents")
def requirement_texts(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "documents").select("doc_id", requirement_text(F.col("text")).alias("requirement"))


_TERMS = {"digital": ["alarm", "sensor", "camera", "electronic record", "tablet"], "pre_digital": ["call light", "binder", "tray", "whistle"]}
_COUNTS = "counts AS (" + " UNION ALL ".join(f"SELECT '{g}' AS term_group, '{t}' AS term, {_tag('f_tag')} AS tag, sum(len(regexp_extract_all(lower(narrative), '\\b{t}\\b')))::BIGINT AS n FROM corpus GROUP BY 3" for g, ts in _TERMS.items() for t in ts) + ")"


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return taxonomy.term_counts(table(spark, d, "corpus").withColumn("f_tag", tag_key(F.col("f_tag"))), _TERMS)


@query(f"WITH {_COUNTS} SELECT term_group, term, sum(n)::BIGINT AS total, count_if(n > 0)::BIGINT AS n_groups FROM counts GROUP BY ALL")
def term_census(spark, d):  # noqa: ANN001, ANN201
    return taxonomy.term_census(_counts(spark, d))


@query(f"WITH {_COUNTS} SELECT term_group, term, f_tag, n, place FROM (SELECT term_group, term, tag AS f_tag, n, row_number() OVER (PARTITION BY term ORDER BY n DESC, tag)::INT AS place FROM counts WHERE n > 0 AND tag IS NOT NULL) WHERE place <= 5")
def term_top_tags(spark, d):  # noqa: ANN001, ANN201
    return taxonomy.top_groups(_counts(spark, d))


@query(f"WITH {_COUNTS}, t AS (SELECT sum(n) FILTER (term_group = 'pre_digital')::BIGINT AS numerator, sum(n) FILTER (term_group = 'digital')::BIGINT AS denominator FROM counts) SELECT numerator, denominator, round(numerator / nullif(denominator, 0), 6) AS ratio FROM t")
def census_ratio(spark, d):  # noqa: ANN001, ANN201
    return r6(taxonomy.census_ratio(_counts(spark, d)))


@query("SELECT names_technology AS level, count(*)::BIGINT AS n_tags FROM tag_taxonomy GROUP BY 1")
def taxonomy_levels(spark, d):  # noqa: ANN001, ANN201
    return taxonomy.level_counts(table(spark, d, "tag_taxonomy").withColumnRenamed("names_technology", "level"))


@query("SELECT doc_id, regexp_matches(text, '" + REFUSAL.replace("'", "''") + "') AS refusal FROM documents WHERE text IS NOT NULL")
def refusal_flag(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "documents").where("text is not null").select("doc_id", looks_like_refusal(F.col("text")).alias("refusal"))


_LOW = "lower(narrative)"
_TECH = "CASE " + " ".join(f"WHEN contains({_LOW}, '{k}') THEN '{v}'" for k, v in judgements.TECHNOLOGY_KEYWORDS) + " ELSE 'none' END"
_SPAN = "CASE " + " ".join(f"WHEN contains({_LOW}, '{k}') THEN '{k}'" for k, _ in judgements.TECHNOLOGY_KEYWORDS) + " ELSE '' END"
_ROLE = "CASE " + " ".join(f"WHEN contains({_LOW}, '{k}') THEN '{v}'" for k, v in judgements.ROLE_KEYWORDS) + " ELSE 'incidental' END"


@query(f"SELECT doc_id, technology_type, CASE WHEN technology_type = 'none' THEN 'none' ELSE role END AS failure_role, technology_type <> 'none' AS technology_present, evidence_span FROM (SELECT doc_id, {_TECH} AS technology_type, {_ROLE} AS role, {_SPAN} AS evidence_span FROM corpus)")
def keyword_label(spark, d):  # noqa: ANN001, ANN201
    j = judgements.keyword_judgement(F.col("narrative"))
    return table(spark, d, "corpus").select("doc_id", *[j[k].alias(k) for k in ("technology_type", "failure_role", "technology_present", "evidence_span")])


@query(f"SELECT doc_id, CASE WHEN s <> '' AND strpos(narrative, s) > 0 THEN (strpos(narrative, s) - 1)::BIGINT END AS span_start, CASE WHEN s <> '' AND strpos(narrative, s) > 0 THEN (strpos(narrative, s) - 1 + length(s))::BIGINT END AS span_end FROM (SELECT doc_id, narrative, {_SPAN} AS s FROM corpus)")
def span_offsets(spark, d):  # noqa: ANN001, ANN201
    c = table(spark, d, "corpus").select("doc_id", "narrative", judgements.keyword_judgement(F.col("narrative"))["evidence_span"].alias("s"))
    a, b = locate_span(F.col("narrative"), F.col("s"))
    return c.select("doc_id", a.alias("span_start"), b.alias("span_end"))


@query(f"SELECT doc_id, true AS parse_ok, CAST(NULL AS VARCHAR) AS parse_error, technology_type FROM (SELECT doc_id, {_TECH} AS technology_type FROM corpus)")
def response_round_trip(spark, d):  # noqa: ANN001, ANN201
    out = judgements.parse_responses(judgements.keyword_responses(table(spark, d, "corpus").select("doc_id", "narrative")), "response", "narrative")
    return out.select("doc_id", "parse_ok", "parse_error", "technology_type")


@query("SELECT count(*)::BIGINT AS n, count_if(parse_ok)::BIGINT AS n_parsed, count_if(NOT parse_ok)::BIGINT AS n_failed, count_if(parse_error = 'refusal')::BIGINT AS n_refused, count(evidence_span_start)::BIGINT AS n_located, round(count_if(NOT parse_ok) / count(*), 6) AS failure_rate FROM extracted")
def extraction_stats(spark, d):  # noqa: ANN001, ANN201
    return r6(judgements.extraction_stats(table(spark, d, "extracted")))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_type(props) = 'OBJECT' AS is_object FROM events")
def json_props_validate(spark, d):  # noqa: ANN001, ANN201
    v = F.try_parse_json("props")
    return table(spark, d, "events").select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), F.schema_of_variant(v).startswith("OBJECT").alias("is_object"))


# --- trends ------------------------------------------------------------------------------------------

_PREV = "count(*)::BIGINT AS n_citations, count_if(tech)::BIGINT AS n_technology, round(count_if(tech) / count(*), 6) AS share, count(DISTINCT survey_id)::BIGINT AS exposure, round(coalesce(count_if(tech) / nullif(count(DISTINCT survey_id), 0), 0), 6) AS rate_per_exposure FROM frame"


@query(f"WITH {_FRAME} SELECT {_PREV}")
def prevalence_overall(spark, d):  # noqa: ANN001, ANN201
    return r6(trends.prevalence(frame(spark, d)))


@query(f"WITH {_FRAME} SELECT year, {_PREV} WHERE year IS NOT NULL GROUP BY year")
def prevalence_by_year(spark, d):  # noqa: ANN001, ANN201
    return r6(trends.prevalence(frame(spark, d), ["year"]))


@query(f"WITH {_FRAME} SELECT year, quarter, {_PREV} WHERE year IS NOT NULL AND quarter IS NOT NULL GROUP BY year, quarter")
def prevalence_by_quarter(spark, d):  # noqa: ANN001, ANN201
    return r6(trends.prevalence(frame(spark, d), ["year", "quarter"]))


@query(f"WITH {_FRAME} SELECT state, year, {_PREV} WHERE state IS NOT NULL AND year IS NOT NULL GROUP BY state, year")
def prevalence_by_state_year(spark, d):  # noqa: ANN001, ANN201
    return r6(trends.prevalence(frame(spark, d), ["state", "year"]))


@query(f"WITH {_FRAME} SELECT 0 AS level, NULL::BIGINT AS year, NULL::BIGINT AS quarter, count(*)::BIGINT AS n_citations, count_if(tech)::BIGINT AS n_technology FROM frame UNION ALL SELECT 1, year, NULL, count(*), count_if(tech) FROM frame WHERE year IS NOT NULL GROUP BY year UNION ALL SELECT 2, year, quarter, count(*), count_if(tech) FROM frame WHERE year IS NOT NULL GROUP BY year, quarter")
def prevalence_rollup(spark, d):  # noqa: ANN001, ANN201
    return trends.prevalence_rollup(frame(spark, d))


@query()
def prevalence_intervals(spark, d):  # noqa: ANN001, ANN201
    return trends.with_intervals(trends.prevalence(frame(spark, d), ["year"]).orderBy("year"), 1000, 7)


@query(f"WITH {_FRAME} SELECT (row_number() OVER (ORDER BY year) - 1)::BIGINT AS t, year::VARCHAR AS label, count_if(tech)::DOUBLE AS y FROM frame WHERE year IS NOT NULL GROUP BY year")
def series_for_forecast(spark, d):  # noqa: ANN001, ANN201
    return trends.series(frame(spark, d))


@query(f"WITH {_FRAME} SELECT count(*)::BIGINT AS n, round(avg((level <> 'full')::INT), 6) AS strict_rate, round(avg((level = 'none')::INT), 6) AS lenient_rate FROM frame WHERE tech")
def gap_strict_lenient(spark, d):  # noqa: ANN001, ANN201
    return r6(trends.gap(frame(spark, d)))


@query(f"WITH {_FRAME} SELECT l.level, count(f.doc_id)::BIGINT AS n FROM (VALUES ('full'), ('partial'), ('none')) l(level) LEFT JOIN frame f ON f.level = l.level AND f.tech GROUP BY 1")
def gap_by_level(spark, d):  # noqa: ANN001, ANN201
    return trends.gap_by_level(frame(spark, d))


@query(f"WITH {_FRAME}, x AS (SELECT 'technology_type' AS field_name, coalesce(technology_type, 'nan') AS value, level FROM frame WHERE tech UNION ALL SELECT 'failure_role', coalesce(failure_role, 'nan'), level FROM frame WHERE tech) SELECT field_name, value, count(*)::BIGINT AS n, round(avg((level <> 'full')::INT), 6) AS strict_rate, round(avg((level = 'none')::INT), 6) AS lenient_rate FROM x GROUP BY ALL")
def gap_breakdown(spark, d):  # noqa: ANN001, ANN201
    return r6(trends.gap_breakdown(frame(spark, d)))


@query(f"WITH {_FRAME} SELECT count(*)::BIGINT AS n, round(avg((level = 'full')::INT), 6) AS share_full, round(avg((level = 'partial')::INT), 6) AS share_partial FROM frame WHERE tech")
def tag_adequacy(spark, d):  # noqa: ANN001, ANN201
    return r6(trends.tag_adequacy(frame(spark, d)))


@query(f"WITH {_FRAME} SELECT failure_role, count(*)::BIGINT AS n FROM frame WHERE tech AND failure_role IS NOT NULL GROUP BY 1 HAVING NOT bool_or(level = 'full')")
def roles_never_legible(spark, d):  # noqa: ANN001, ANN201
    return trends.roles_never_legible(frame(spark, d))


@query(f"WITH {_FRAME} SELECT tag AS f_tag, count(*)::BIGINT AS n FROM frame WHERE tech AND tag IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
def top_tags(spark, d):  # noqa: ANN001, ANN201
    return trends.top_tags(frame(spark, d))


@query(f"WITH {_FRAME}, t AS (SELECT coalesce(technology_type, 'nan') AS technology_type, level, count(*)::BIGINT AS n FROM frame WHERE tech GROUP BY ALL) SELECT technology_type, level, n, round(n / sum(n) OVER (PARTITION BY technology_type), 6) AS share FROM t")
def technology_flow(spark, d):  # noqa: ANN001, ANN201
    return r6(trends.technology_flow(frame(spark, d)))


@query(f"WITH {_FRAME} SELECT nullif(substr(upper(trim(scope_severity)), 1, 1), '') AS letter, count(*)::BIGINT AS n, round(avg(tech::INT), 6) AS share FROM frame WHERE nullif(substr(upper(trim(scope_severity)), 1, 1), '') IS NOT NULL GROUP BY 1")
def severity_gradient(spark, d):  # noqa: ANN001, ANN201
    return r6(trends.severity_gradient(frame(spark, d), F.nullif(grid_letter(F.col("scope_severity")), F.lit(""))))


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, count(*)::BIGINT AS n, count_if(event_type = 'purchase')::BIGINT AS n_positive, round(count_if(event_type = 'purchase') / count(*), 6) AS share FROM events GROUP BY 1")
def windowed_event_share(spark, d):  # noqa: ANN001, ANN201
    return r6(windowed_share(table(spark, d, "events"), F.col("event_type") == "purchase")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


# --- agreement and reliability -----------------------------------------------------------------------

_CELLS = "cells AS (SELECT count(*)::BIGINT AS n, count_if(gold AND pred)::BIGINT AS tp, count_if(NOT gold AND pred)::BIGINT AS fp, count_if(gold AND NOT pred)::BIGINT AS fn, count_if(NOT gold AND NOT pred)::BIGINT AS tn FROM gold JOIN model USING (doc_id))"


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return agreement.binary_cells(gold(spark, d).join(model(spark, d), "doc_id"), F.col("gold"), F.col("pred"))


@query(f"""WITH {_GOLD}, {_CELLS}, k AS (SELECT *, (tp + tn) / n AS po, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)::DOUBLE AS pe FROM cells)
SELECT n, tp, fp, fn, tn, round(po, 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS "precision", round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
round(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END, 6) AS kappa, round((tp + fn) / n, 6) AS gold_prevalence, round((tp + fp) / n, 6) AS pred_prevalence FROM k""")
def confusion_binary(spark, d):  # noqa: ANN001, ANN201
    return r6(agreement.binary_scores(_cells(spark, d)))


@query(f"WITH {_GOLD}, {_CELLS} SELECT n, tp, fp, fn, tn, round(tp / nullif(tp + fn, 0), 6) AS sensitivity, round(tn / nullif(tn + fp, 0), 6) AS specificity FROM cells")
def sensitivity_specificity(spark, d):  # noqa: ANN001, ANN201
    return r6(agreement.sensitivity_specificity(_cells(spark, d)))


def _roles(spark: SparkSession, d: str) -> DataFrame:
    v = votes(spark, d).where(F.col("failure_role").isin(*FAILURE_ROLES)).groupBy("doc_id").agg(F.min("failure_role").alias("gold_role"))
    return v.join(model(spark, d).where("role is not null"), "doc_id")


_R = "'" + "', '".join(FAILURE_ROLES) + "'"
_ROLECELLS = f"role_pairs AS (SELECT g.gold_role, m.role FROM (SELECT doc_id, min(role) AS gold_role FROM votes WHERE role IN ({_R}) GROUP BY 1) g JOIN model m USING (doc_id) WHERE m.role IS NOT NULL)"


@query(f"WITH {_GOLD}, {_ROLECELLS}, l AS (SELECT unnest([{_R}]) AS x) SELECT a.x AS gold, b.x AS pred, count(p.role)::BIGINT AS n FROM l a CROSS JOIN l b LEFT JOIN role_pairs p ON p.gold_role = a.x AND p.role = b.x GROUP BY ALL")
def confusion_multiclass(spark, d):  # noqa: ANN001, ANN201
    return agreement.confusion(_roles(spark, d), "gold_role", "role", list(FAILURE_ROLES))


@query(f"""WITH {_GOLD}, {_ROLECELLS}, l AS (SELECT unnest([{_R}]) AS label)
SELECT label, support, round(coalesce(tp / nullif(predicted, 0), 0), 6) AS "precision", round(coalesce(tp / nullif(support, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(predicted + support, 0), 0), 6) AS f1
FROM (SELECT label, (SELECT count(*) FROM role_pairs WHERE gold_role = label)::BIGINT AS support, (SELECT count(*) FROM role_pairs WHERE role = label) AS predicted, (SELECT count(*) FROM role_pairs WHERE role = label AND gold_role = label) AS tp FROM l)""")
def class_scores(spark, d):  # noqa: ANN001, ANN201
    return r6(agreement.class_scores(agreement.confusion(_roles(spark, d), "gold_role", "role", list(FAILURE_ROLES))))


_CLASS_F1 = f"SELECT label, support, coalesce(2 * tp / nullif(predicted + support, 0), 0) AS f1 FROM (SELECT label, (SELECT count(*) FROM role_pairs WHERE gold_role = label)::BIGINT AS support, (SELECT count(*) FROM role_pairs WHERE role = label) AS predicted, (SELECT count(*) FROM role_pairs WHERE role = label AND gold_role = label) AS tp FROM l)"


@query(f"WITH {_GOLD}, {_ROLECELLS}, l AS (SELECT unnest([{_R}]) AS label), f AS ({_CLASS_F1}) SELECT round(avg(f1), 6) AS macro_f1, count(*)::BIGINT AS n_labels FROM f")
def macro_f1(spark, d):  # noqa: ANN001, ANN201
    return r6(agreement.macro_f1(agreement.confusion(_roles(spark, d), "gold_role", "role", list(FAILURE_ROLES))))


@query(f"""WITH {_GOLD}, {_ROLECELLS}, n AS (SELECT count(*) AS n, count_if(gold_role = role) AS s FROM role_pairs),
e AS (SELECT sum(g.c * p.c)::DOUBLE AS gp FROM (SELECT gold_role AS x, count(*) AS c FROM role_pairs GROUP BY 1) g JOIN (SELECT role AS x, count(*) AS c FROM role_pairs GROUP BY 1) p USING (x))
SELECT n::BIGINT AS n, round(s / n, 6) AS agreement, round(CASE WHEN gp / (n * n) < 1 THEN (s / n - gp / (n * n)) / (1 - gp / (n * n)) END, 6) AS kappa FROM n, e""")
def cohens_kappa(spark, d):  # noqa: ANN001, ANN201
    return r6(agreement.cohens_kappa(agreement.confusion(_roles(spark, d), "gold_role", "role")))


_V1, _V2 = "alarm|sensor|camera", "alarm|sensor|camera|call light|record"


def _variants(spark: SparkSession, d: str) -> DataFrame:
    low = F.lower("narrative")
    return table(spark, d, "corpus").select("doc_id", facility_key(F.col("ccn")).alias("ccn"), low.rlike(_V1).alias("v1"), low.rlike(_V2).alias("v2")).join(model(spark, d).select("doc_id", F.col("pred").alias("v3")), "doc_id")


_VARIANTS = f"v AS (SELECT c.doc_id, {_ccn('c.ccn')} AS ccn, regexp_matches(lower(narrative), '{_V1}') AS v1, regexp_matches(lower(narrative), '{_V2}') AS v2, m.pred AS v3 FROM corpus c JOIN model m USING (doc_id))"


@query(f"""WITH {_GOLD}, {_VARIANTS}, p AS (SELECT avg(v1::INT) AS a, avg(v2::INT) AS b, avg(v3::INT) AS c, (avg((v1 = v2)::INT) + avg((v1 = v3)::INT) + avg((v2 = v3)::INT)) / 3 AS m FROM v)
SELECT round(least(a, b, c), 6) AS min_prevalence, round(greatest(a, b, c), 6) AS max_prevalence, round(greatest(a, b, c) - least(a, b, c), 6) AS prevalence_spread, round(m, 6) AS mean_agreement FROM p""")
def prompt_sensitivity(spark, d):  # noqa: ANN001, ANN201
    return r6(agreement.prompt_sensitivity(_variants(spark, d), ["v1", "v2", "v3"]))


@query(f"WITH {_GOLD}, {_VARIANTS} SELECT variant, count(*)::BIGINT AS n, round(avg(y::INT), 6) AS prevalence FROM (SELECT 'v1' AS variant, v1 AS y FROM v UNION ALL SELECT 'v2', v2 FROM v UNION ALL SELECT 'v3', v3 FROM v) GROUP BY 1")
def variant_prevalence(spark, d):  # noqa: ANN001, ANN201
    return r6(agreement.variant_prevalence(_variants(spark, d), ["v1", "v2", "v3"]))


@query(f"WITH {_GOLD}, {_VARIANTS}, x AS (SELECT 'v1' AS variant_a, 'v2' AS variant_b, v1 AS g, v2 AS p FROM v UNION ALL SELECT 'v1', 'v3', v1, v3 FROM v UNION ALL SELECT 'v2', 'v3', v2, v3 FROM v), k AS (SELECT variant_a, variant_b, avg((g = p)::INT) AS po, avg(g::INT) * avg(p::INT) + (1 - avg(g::INT)) * (1 - avg(p::INT)) AS pe FROM x GROUP BY ALL) SELECT variant_a, variant_b, round(po, 6) AS agreement, round((po - pe) / (1 - pe), 6) AS kappa FROM k")
def pairwise_agreement(spark, d):  # noqa: ANN001, ANN201
    return r6(agreement.variant_pairs(_variants(spark, d), ["v1", "v2", "v3"]))


@query(f"""WITH {_GOLD}, {_VARIANTS}, f AS (SELECT ccn, avg(v2::INT) AS a, avg(v3::INT) AS b FROM v WHERE ccn IS NOT NULL GROUP BY ccn HAVING count(*) >= 5),
k AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE AS x, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0::DOUBLE AS y FROM f)
SELECT count(*)::BIGINT AS n, round(CASE WHEN count(*) >= 2 THEN corr(x, y) END, 6) AS rho FROM k""")
def facility_rates_spearman(spark, d):  # noqa: ANN001, ANN201
    return r6(agreement.spearman(agreement.facility_rates(_variants(spark, d), "v2", "v3"), "rate_a", "rate_b"))


@query("""WITH a AS (SELECT doc_id, annotator, labelled_at, coalesce(technology_present::INT, -1) AS p, coalesce(failure_role, '') AS r FROM annotations WHERE labelled_at IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, annotator ORDER BY labelled_at, p, r) AS i, row_number() OVER (PARTITION BY doc_id, annotator ORDER BY labelled_at DESC, p DESC, r DESC) AS j FROM a)
SELECT count(*)::BIGINT AS n, round(avg((x.p = y.p)::INT), 6) AS technology_present, round(avg((x.r = y.r)::INT), 6) AS failure_role FROM o x JOIN o y ON x.doc_id = y.doc_id AND x.annotator = y.annotator AND x.i = 1 AND y.j = 1""")
def self_consistency(spark, d):  # noqa: ANN001, ANN201
    """The first against the last pass of every annotator over a narrative."""
    fields = [F.coalesce(F.col("technology_present").cast("int"), F.lit(-1)).alias("technology_present"), F.coalesce("failure_role", F.lit("")).alias("failure_role")]
    a = table(spark, d, "annotations").where("labelled_at is not null").select("doc_id", "annotator", F.struct("labelled_at", *fields).alias("v"))
    both = a.groupBy(F.concat_ws("|", "doc_id", F.col("annotator").cast("string")).alias("doc_id")).agg(F.min("v").alias("first"), F.max("v").alias("last"))
    return r6(agreement.self_consistency(both.select("doc_id", "first.*"), both.select("doc_id", "last.*"), ["technology_present", "failure_role"]))


def _alpha_sql(value: str, distance: str) -> str:
    return f"""WITH {_GOLD}, c AS (SELECT doc_id AS u, {value} AS v, count(*) AS n FROM votes WHERE {value} IS NOT NULL GROUP BY ALL), m AS (SELECT u, sum(n) AS m FROM c GROUP BY 1 HAVING sum(n) > 1),
o AS (SELECT a.v AS va, b.v AS vb, sum(a.n * (b.n - (a.v = b.v)::INT) / (m.m - 1)::DOUBLE) AS o FROM c a JOIN c b USING (u) JOIN m USING (u) GROUP BY ALL),
g AS (SELECT va AS v, sum(o) AS k FROM o GROUP BY 1), gg AS (SELECT v, k, sum(k) OVER (ORDER BY v) AS up, sum(k) OVER () AS total FROM g),
p AS (SELECT a.v AS va, b.v AS vb, a.k AS na, b.k AS nb, a.up AS ua, b.up AS ub, a.total FROM gg a CROSS JOIN gg b), d AS (SELECT p.*, coalesce(o.o, 0) AS o, {distance} AS d FROM p LEFT JOIN o ON o.va = p.va AND o.vb = p.vb)
SELECT count(DISTINCT va)::BIGINT AS n_values, round(max(total), 6) AS total, round(sum(o * d), 6) AS observed, round(sum((na * nb - (va = vb)::INT * na) * d) / (max(total) - 1), 6) AS expected, round(1 - sum(o * d) / (sum((na * nb - (va = vb)::INT * na) * d) / (max(total) - 1)), 6) AS alpha FROM d"""


_ROLECODE = f"list_position([{_R}], role)"


def _role_codes(spark: SparkSession, d: str) -> DataFrame:
    number: Column = F.array_position(F.array(*[F.lit(x) for x in FAILURE_ROLES]), F.col("failure_role")).cast("int")
    return votes(spark, d).select(F.col("doc_id").alias("unit"), F.col("annotator").alias("coder"), F.nullif(number, F.lit(0)).alias("value")).where("value is not null")


@query(_alpha_sql("tp::INT", "(p.va <> p.vb)::INT::DOUBLE"))
def alpha_nominal(spark, d):  # noqa: ANN001, ANN201
    return r6(reliability.alpha_terms(codes(spark, d, "technology_present").withColumn("value", F.col("value").cast("int")), "nominal"))


@query(_alpha_sql(_ROLECODE, "CASE WHEN p.va = p.vb THEN 0 ELSE power(abs(ub - ua) + CASE WHEN ua <= ub THEN na ELSE nb END - (na + nb) / 2, 2) END"))
def alpha_ordinal(spark, d):  # noqa: ANN001, ANN201
    return r6(reliability.alpha_terms(_role_codes(spark, d), "ordinal"))


@query(_alpha_sql(_ROLECODE, "power(p.va - p.vb, 2)::DOUBLE"))
def alpha_interval(spark, d):  # noqa: ANN001, ANN201
    return r6(reliability.alpha_terms(_role_codes(spark, d), "interval"))


@query(_alpha_sql(_ROLECODE, "power((p.va - p.vb) / (p.va + p.vb), 2)::DOUBLE"))
def alpha_ratio(spark, d):  # noqa: ANN001, ANN201
    return r6(reliability.alpha_terms(_role_codes(spark, d), "ratio"))


@query(f"""WITH {_GOLD}, c AS (SELECT l.x AS category, doc_id, count(*) AS m, count_if(role = l.x) AS k FROM votes, (SELECT unnest([{_R}]) AS x) l WHERE role IS NOT NULL GROUP BY ALL HAVING count(*) > 1),
t AS (SELECT category, sum(m)::DOUBLE AS n, sum(k)::DOUBLE AS n1, sum(2 * k * (m - k) / (m - 1)::DOUBLE) AS o FROM c GROUP BY 1)
SELECT category, round(CASE WHEN n <= 1 THEN NULL WHEN n1 = 0 OR n1 = n THEN 1.0 ELSE 1 - o / (2 * n1 * (n - n1) / (n - 1)) END, 6) AS alpha FROM t""")
def alpha_by_category(spark, d):  # noqa: ANN001, ANN201
    return r6(reliability.alpha_by_category(codes(spark, d, "failure_role"), list(FAILURE_ROLES)))


@query(f"""WITH {_GOLD}, v AS (SELECT doc_id AS u, tp::INT AS v, annotator AS a FROM votes WHERE tp IS NOT NULL), m AS (SELECT u, count(*) AS m FROM v GROUP BY 1 HAVING count(*) > 1)
SELECT round(1.0::DOUBLE / (m - 1), 6) AS weight, (x.v <> y.v)::INT::DOUBLE AS d, count(*)::DOUBLE AS n_pairs FROM v x JOIN v y ON x.u = y.u AND x.a < y.a JOIN m ON m.u = x.u GROUP BY ALL""")
def alpha_pairs(spark, d):  # noqa: ANN001, ANN201
    return r6(reliability.pair_decomposition(codes(spark, d, "technology_present").withColumn("value", F.col("value").cast("int"))))


@query()
def alpha_bootstrap_q(spark, d):  # noqa: ANN001, ANN201
    b = reliability.alpha_bootstrap(codes(spark, d, "technology_present").withColumn("value", F.col("value").cast("int")), "nominal", 10_000, 0.8, 11)
    return spark.createDataFrame([(b["point"], b["lo"], b["hi"], b["q"], b["n_pairs"])], "point double, lo double, hi double, q double, n_pairs bigint")


@query(f"WITH {_GOLD} SELECT doc_id AS unit, " + ", ".join(f"max(tp::INT) FILTER (annotator = {a}) AS coder_{a}" for a in range(14)) + " FROM votes WHERE tp IS NOT NULL GROUP BY 1")
def coder_matrix(spark, d):  # noqa: ANN001, ANN201
    m = reliability.coder_matrix(codes(spark, d, "technology_present").withColumn("value", F.col("value").cast("int")))
    return m.select("unit", *[(F.col(f"`{a}`") if str(a) in m.columns else F.lit(None).cast("int")).alias(f"coder_{a}") for a in range(14)])


@query("SELECT unnest(['ownership_type', 'state', 'certified_beds']) AS \"column\", unnest([0, 0, n]) AS n_failed FROM (SELECT count_if(number_of_certified_beds IS NOT NULL AND TRY_CAST(trim(number_of_certified_beds) AS BIGINT) IS NULL)::BIGINT AS n FROM provider_information)")
def failed_casts(spark, d):  # noqa: ANN001, ANN201
    return corpus.cast_failures(table(spark, d, "provider_information").select("ownership_type", "state", F.col("number_of_certified_beds").alias("certified_beds")))


@query(f"SELECT doc_id, {_TECH} AS technology_type, CASE WHEN {_TECH} = 'none' THEN 'none' ELSE {_ROLE} END AS failure_role FROM corpus WHERE narrative IS NOT NULL")
def backend_round_trip(spark, d):  # noqa: ANN001, ANN201
    """Prompts built, answered by the keyword backend and parsed; the instructions name categories that must not be matched."""
    c = table(spark, d, "corpus").where("narrative is not null").select("doc_id", F.concat(F.lit("Read. NARRATIVE:\n"), "narrative", F.lit("\nINSTRUCTIONS: choose call_light, alarm, sensor or camera, malfunction or disabled.")).alias("prompt"))
    return judgements.parse_responses(judgements.run_backend(c, "prompt", "keyword")).select("doc_id", "technology_type", "failure_role")


@query("SELECT doc_id FROM corpus ORDER BY doc_id LIMIT 50")
def pilot_rows(spark, d):  # noqa: ANN001, ANN201
    return judgements.pilot(table(spark, d, "corpus"), 50).select("doc_id")


# --- estimators --------------------------------------------------------------------------------------


@query("SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) AS c_acctbal_z FROM customer")
def standardised_covariates(spark, d):  # noqa: ANN001, ANN201
    return r6(stats.standardise(table(spark, d, "customer"), ["c_acctbal"]).select("c_custkey", "c_acctbal_z"))


def _fe(spark: SparkSession, d: str) -> DataFrame:
    f = frame(spark, d).where("technology_present")
    return f.select(facility_key(F.col("ccn")).alias("ccn"), "severity_level", F.col("illegible").cast("double").alias("y"), (F.coalesce(F.col("n_tokens"), F.lit(0)) / 100.0).alias("x"))


_FE = f"fe AS (SELECT {_ccn('ccn')} AS g, severity_level, (level <> 'full')::INT::DOUBLE AS y, coalesce(n_tokens, 0) / 100.0::DOUBLE AS x FROM frame WHERE tech AND {_ccn('ccn')} IS NOT NULL)"


@query(f"WITH {_FRAME}, {_FE}, c AS (SELECT g, x - avg(x) OVER (PARTITION BY g) AS x, y - avg(y) OVER (PARTITION BY g) AS y FROM fe) SELECT count(*)::BIGINT AS n, count(DISTINCT g)::BIGINT AS n_groups, round(sum(x * y) / sum(x * x), 6) AS beta FROM c")
def fe_ols_slope(spark, d):  # noqa: ANN001, ANN201
    return r6(stats.fe_slope(_fe(spark, d), "y", "x", "ccn"))


@query(f"WITH {_FRAME}, {_FE}, s AS (SELECT *, coalesce(severity_level, -1) AS stratum FROM fe), k AS (SELECT stratum FROM s GROUP BY 1 HAVING count(*) >= 30 AND min(y) <> max(y)), c AS (SELECT stratum, g, x - avg(x) OVER (PARTITION BY stratum, g) AS x, y - avg(y) OVER (PARTITION BY stratum, g) AS y FROM s WHERE stratum IN (SELECT stratum FROM k)) SELECT stratum, count(*)::BIGINT AS n, count(DISTINCT g)::BIGINT AS n_groups, round(sum(x * y) / sum(x * x), 6) AS beta FROM c GROUP BY 1")
def matched_severity(spark, d):  # noqa: ANN001, ANN201
    return r6(stats.matched_severity(_fe(spark, d), "y", "x", "ccn", F.col("severity_level")))


@query()
def equity_coefficients(spark, d):  # noqa: ANN001, ANN201
    return stats.equity_model(frame(spark, d), ["severity_level", "n_tokens"], F.col("illegible"), n_boot=500, seed=5)


@query()
def two_way_effects(spark, d):  # noqa: ANN001, ANN201
    f = frame(spark, d).where("technology_present and state is not null and year is not null").select("state", "year", F.col("illegible").cast("double").alias("y"), (F.coalesce(F.col("n_tokens"), F.lit(0)) / 100.0).alias("x"))
    return spark.createDataFrame([(stats.two_way_slope(f, "y", "x", "state", "year"),)], "beta double")


@query(f"WITH {_GOLD}, {_CELLS}, a AS (SELECT avg(pred::INT) AS p FROM model) SELECT round(p, 6) AS apparent, round(greatest(0, least(1, (p + tn / (tn + fp) - 1) / (tp / (tp + fn) + tn / (tn + fp) - 1))), 6) AS corrected FROM cells, a")
def rogan_gladen_point(spark, d):  # noqa: ANN001, ANN201
    """The bare formula, near chance too, and 1 where it is undefined, as in the SQL; `corrected_prevalence` is what refuses there."""
    apparent = model(spark, d).agg(F.avg(F.col("pred").cast("int")).alias("apparent"))
    cells = agreement.sensitivity_specificity(_cells(spark, d)).crossJoin(apparent)
    above, power = F.col("apparent") + F.col("specificity") - 1, F.col("sensitivity") + F.col("specificity") - 1
    corrected = F.when(power != 0, F.try_divide(above, power)).when(above < 0, 0.0)
    return r6(cells.select("apparent", F.greatest(F.lit(0.0), F.least(F.lit(1.0), corrected)).alias("corrected")))


@query()
def corrected_prevalence(spark, d):  # noqa: ANN001, ANN201
    """Where the correction refuses, its reason stands in the place of an estimate, as in the reference's stage."""
    c = _cells(spark, d).first().asDict()
    p = model(spark, d).agg(F.avg(F.col("pred").cast("int"))).first()[0]
    try:
        b = stats.corrected_prevalence(p, c, 2000, 3)
        row = (b["point"], b["lo"], b["hi"], b["skipped"], None)
    except AnalysisError as e:
        row = (None, None, None, None, str(e))
    return spark.createDataFrame([row], "point double, lo double, hi double, skipped int, correction_unavailable string")


@query()
def error_audit(spark, d):  # noqa: ANN001, ANN201
    rows = gold(spark, d).join(model(spark, d), "doc_id").join(table(spark, d, "corpus").select("doc_id", "severity_level", "certified_beds"), "doc_id")
    return stats.error_audit(rows, F.col("gold") != F.col("pred"), ["severity_level", "certified_beds"], 1000, 3)


# --- diffusion ---------------------------------------------------------------------------------------


@query("""SELECT t::BIGINT AS t, round(1000 * (1 - exp(-0.41 * t)) / (1 + 40 * exp(-0.41 * t)), 6) AS bass, round(1000 * 0.41 * 0.41 / 0.01 * exp(-0.41 * t) / power(1 + 40 * exp(-0.41 * t), 2), 6) AS bass_rate,
round(1000 / (1 + exp(-0.3 * (t - 12.0))), 6) AS logistic FROM range(0, 40) r(t)""")
def diffusion_curves(spark, d):  # noqa: ANN001, ANN201
    t = F.col("t").cast("double")
    s = spark.range(40).withColumnRenamed("id", "t")
    return r6(s.select("t", diffusion.bass_cumulative(t, 0.01, 0.4, 1000).alias("bass"), diffusion.bass_rate(t, 0.01, 0.4, 1000).alias("bass_rate"), diffusion.logistic_cumulative(t, 1000, 0.3, 12).alias("logistic")))


def _orders(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "orders").groupBy((F.year("o_orderdate") * 4 + F.quarter("o_orderdate") - 1).alias("q")).agg(F.count(F.lit(1)).cast("double").alias("y"))
    first = q.agg(F.min("q")).first()[0]
    return q.select((F.col("q") - F.lit(first)).cast("bigint").alias("t"), "y")


_ORDERS = "q AS (SELECT year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS q, count(*)::DOUBLE AS y FROM orders GROUP BY 1), s AS (SELECT (q - (SELECT min(q) FROM q))::BIGINT AS t, y FROM q)"


@query(f"WITH {_ORDERS}, l AS (SELECT arg_max(y, t) AS last FROM s WHERE t < 16) SELECT count(*)::BIGINT AS n_test, round(sqrt(avg((last - y) * (last - y))), 6) AS naive_rmse, round(avg(abs((last - y) / y)), 6) AS naive_mape FROM s, l WHERE t >= 16")
def backtest_naive(spark, d):  # noqa: ANN001, ANN201
    return r6(forecast.backtest_naive(_orders(spark, d), 16))


@query(f"WITH {_ORDERS}, p AS (SELECT count(*)::BIGINT AS n, max(y) AS y_peak FROM s), k AS (SELECT min(t) AS t_peak FROM s, p WHERE y = y_peak), z AS (SELECT avg(y) AS last_two, min(t) AS tt FROM (SELECT * FROM s ORDER BY t DESC LIMIT 2)) SELECT n, t_peak, y_peak, round(last_two, 6) AS last_two, (n >= 12 AND t_peak < tt AND last_two < 0.9 * y_peak) AS identifiable FROM p, k, z")
def identifiability(spark, d):  # noqa: ANN001, ANN201
    return r6(forecast.identifiability(_orders(spark, d)))


def _series(spark: SparkSession, d: str) -> tuple[np.ndarray, np.ndarray]:
    s = _orders(spark, d).orderBy("t").collect()
    return np.array([x["t"] for x in s], float), np.array([x["y"] for x in s])


@query()
def diffusion_fits(spark, d):  # noqa: ANN001, ANN201
    c = forecast.compare(*_series(spark, d))
    return spark.createDataFrame([(f.model, *[float(x) for x in f.vector], f.rmse, f.aic, f.bic, f.converged, f.model == c["best"]) for f in c["fits"]], "model string, a double, b double, c double, rmse double, aic double, bic double, converged boolean, best boolean")


@query()
def scenario_projection(spark, d):  # noqa: ANN001, ANN201
    t, y = _series(spark, d)
    return forecast.project(spark, forecast.fit_series("logistic", t, y), t, y, list(forecast.SCENARIOS.values()), 12, 200, seed=2)


@query()
def prediction_intervals(spark, d):  # noqa: ANN001, ANN201
    t, y = _series(spark, d)
    return forecast.prediction_intervals(spark, forecast.fit_series("logistic", t, y), t, y, 8, 200, seed=2)


@query()
def diffusion_by_state(spark, d):  # noqa: ANN001, ANN201
    f = frame(spark, d).where("state is not null and year is not null").groupBy(F.upper(F.trim("state")).alias("state"), (F.col("year") - 2016).alias("t")).agg(F.count(F.lit(1)).cast("double").alias("y"))
    return forecast.fit_groups(f.select("state", F.col("t").cast("double").alias("t"), "y"), "state")


# --- release and gate --------------------------------------------------------------------------------


@query(f"WITH {_FRAME} SELECT count(*)::BIGINT AS n_combinations, count_if(c < 10)::BIGINT AS n_small, coalesce(sum(c) FILTER (c < 10), 0)::BIGINT AS rows_at_risk FROM (SELECT count(*) AS c FROM frame GROUP BY state, year, quarter, technology_type)")
def k_anonymity(spark, d):  # noqa: ANN001, ANN201
    return release.k_anonymity(frame(spark, d), ["state", "year", "quarter", "technology_type"])


_FQ = "fq AS (SELECT ccn, year, quarter, count(*)::BIGINT AS n, count_if(tech)::BIGINT AS n_technology FROM frame WHERE ccn IS NOT NULL AND year IS NOT NULL AND quarter IS NOT NULL GROUP BY ALL)"


@query(f"WITH {_FRAME}, {_FQ} SELECT ccn, year, quarter, CASE WHEN n >= 10 THEN n END AS n, CASE WHEN n >= 10 THEN n_technology END AS n_technology, n < 10 AS suppressed FROM fq")
def suppressed_cells(spark, d):  # noqa: ANN001, ANN201
    return release.suppress_small_cells(release.facility_quarter(frame(spark, d)), "n", 10, ["n_technology"])


@query(f"WITH {_FRAME}, {_FQ} SELECT count(*)::BIGINT AS n_rows, 0::BIGINT AS n_offending FROM fq")
def cell_check(spark, d):  # noqa: ANN001, ANN201
    return release.check_cells(release.suppress_small_cells(release.facility_quarter(frame(spark, d)), "n", 10, ["n_technology"]))


@query("SELECT doc_id, ccn, year, quarter, state, f_tag, scope_severity FROM corpus")
def release_projection(spark, d):  # noqa: ANN001, ANN201
    return release.prepare_annotations(table(spark, d, "corpus")).select("doc_id", "ccn", "year", "quarter", "state", "f_tag", "scope_severity")


_TT = "'" + "', '".join(TECHNOLOGY_TYPES) + "'"


@query(f"""WITH x AS (SELECT count_if(technology_type NOT IN ({_TT}))::BIGINT AS t, count_if(failure_role NOT IN ({_R}))::BIGINT AS r FROM annotations)
SELECT 'technology_type' AS field_name, 'not permitted' AS problem, t AS n FROM x WHERE t > 0 UNION ALL SELECT 'failure_role', 'not permitted', r FROM x WHERE r > 0
UNION ALL SELECT unnest(['annotator', 'labelled_at']), 'extra', 1 UNION ALL SELECT unnest(['ccn', 'year', 'quarter', 'state', 'f_tag', 'scope_severity', 'harm_linked', 'evidence_span_start', 'evidence_span_end', 'confidence', 'model_id', 'model_revision', 'prompt_hash']), 'missing', 1""")
def schema_validation(spark, d):  # noqa: ANN001, ANN201
    return release.validate_schema(table(spark, d, "annotations"))


@query("""SELECT field_name, reason, count(*)::BIGINT AS n FROM (SELECT f AS field_name, CASE WHEN length(v) > 64 THEN 'too_long' WHEN regexp_matches(v, '\\S\\s+\\S+\\s+\\S') THEN 'prose' END AS reason
FROM (SELECT 'ownership_type' AS f, ownership_type AS v FROM provider_information UNION ALL SELECT 'number_of_certified_beds', number_of_certified_beds FROM provider_information UNION ALL SELECT 'state', state FROM provider_information UNION ALL SELECT 'cms_certification_number_ccn', cms_certification_number_ccn FROM provider_information)) WHERE reason IS NOT NULL GROUP BY ALL""")
def free_text_scan(spark, d):  # noqa: ANN001, ANN201
    return release.scan_free_text(table(spark, d, "provider_information"))


def _prompt_variants(spark: SparkSession, d: str) -> DataFrame:
    low = F.lower("narrative")
    pair = lambda name, c: F.struct(F.lit(name).alias("variant"), c.alias("technology_present"))
    c = table(spark, d, "corpus").select("doc_id", F.explode(F.array(pair("v1", low.rlike(_V1)), pair("v2", low.rlike(_V2)))).alias("p"))
    return c.select("doc_id", "p.*")


@query()
def gate_checks(spark, d):  # noqa: ANN001, ANN201
    """All seven checks on a sample of the labelled narratives; keyword rules stand for the second prompt and the second model."""
    labelled = table(spark, d, "corpus").join(table(spark, d, "annotations").select("doc_id").distinct(), "doc_id", "left_semi")
    variants = _prompt_variants(spark, d)
    tables = {"corpus": labelled, "extracted": table(spark, d, "extracted"), "annotations": table(spark, d, "annotations"), "predictions": variants, "second_model": variants.where("variant = 'v1'")}
    return gate_table(spark, validate_measurement(tables, Config(), 11))


@query()
def gate_passed(spark, d):  # noqa: ANN001, ANN201
    return gate_verdict(gate_checks(spark, d))
