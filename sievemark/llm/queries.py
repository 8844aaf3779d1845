"""Queries of the training-data operators over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.llm.chunking import split_oversized
from sievemark.llm.consensus import LABELS, annotator_consensus
from sievemark.llm.decontaminate import find_leaks
from sievemark.llm.pii import find_personal_information, redact
from sievemark.llm.quality import STATISTICS, classify_forms, text_statistics
from sievemark.llm.sampling import category_counts, corpus_categories, corpus_rows, draw_samples, sample_report, target_shortfalls
from sievemark.llm.tokenize import encode_corpus
from sievemark.session import checkpointed, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return find_personal_information(table(spark, d, "corpus")).select("doc_id", "kind").distinct()


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    return redact(table(spark, d, "corpus"))


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return category_counts(corpus_categories(table(spark, d, "corpus"), table(spark, d, "extracted")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return target_shortfalls(table(spark, d, "sample_targets"), _counts(spark, d)).where("not met").select("plan_id", "field_name", "category").distinct()


def p2_sample(spark: SparkSession, d: str) -> DataFrame:
    return draw_samples(corpus_rows(table(spark, d, "corpus"), table(spark, d, "extracted")), table(spark, d, "sample_targets"))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus_rows(table(spark, d, "corpus"), table(spark, d, "extracted"))
    return sample_report(checkpointed(p2_sample(spark, d)), table(spark, d, "sample_targets"), _counts(spark, d), rows)


def p2_availability(spark: SparkSession, d: str) -> DataFrame:
    """Every target with what is available and by how much that falls short."""
    return target_shortfalls(table(spark, d, "sample_targets"), _counts(spark, d)).drop("target_share", "wanted")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return annotator_consensus(table(spark, d, "annotations"))[0].select("doc_id", "field_name", "label")


def p6_consensus(spark: SparkSession, d: str) -> DataFrame:
    """Labels with their number of votes, weighted support and agreement."""
    return annotator_consensus(table(spark, d, "annotations"))[0]


def p6_agreement(spark: SparkSession, d: str) -> DataFrame:
    """How many votes each item and field has, and the share of pairs of annotators who agree."""
    out = annotator_consensus(table(spark, d, "annotations"))[0]
    return out.select("doc_id", "field_name", "n_votes", F.round("agreement", 6).alias("agreement"))


def p6_reliability(spark: SparkSession, d: str) -> DataFrame:
    return annotator_consensus(table(spark, d, "annotations"))[1]


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(table(spark, d, "corpus")).select("doc_id", "cut").distinct()


def p7_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(table(spark, d, "corpus"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return classify_forms(table(spark, d, "documents")).where("form != 'prose'").select("doc_id", "form").distinct()


def p10_counts(spark: SparkSession, d: str) -> DataFrame:
    """The statistics that plain SQL can say: tokens, characters, mean word length and shares of digits, signs and sentence ends."""
    s = text_statistics(table(spark, d, "documents"))
    r = lambda c: F.round(c, 6).alias(c)
    return s.select("doc_id", F.col("n_tokens").cast("bigint").alias("n_tokens"), F.col("n_chars").cast("bigint").alias("n_chars"), r("mean_word_length"), r("digit_ratio"), r("symbol_ratio"), r("end_punctuation"))


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Statistics, distance and the contribution of each statistic, one column each."""
    out = classify_forms(table(spark, d, "documents"))
    return out.select("doc_id", "language", "n_words", "n_chars", *STATISTICS, "distance", *[F.col("contributions")[x].alias(f"due_to_{x}") for x in STATISTICS], "form")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_redacted, p2_found, p2_sample, p2_report, p2_availability, p6_found, p6_consensus, p6_agreement, p6_reliability, p7_found, p7_pieces, p8_ids, p9_found, p10_found, p10_counts, p10_statistics)}
_TYPES, _ROLES = ("'" + "', '".join(LABELS[k]) + "'" for k in ("technology_type", "failure_role"))
_CANON = r"regexp_replace(lower(trim({})), '[\s-]+', '_', 'g')"
_AVAILABLE = """
WITH rows AS (
  SELECT DISTINCT doc_id, 'state' AS field_name, upper(trim(state)) AS category FROM corpus WHERE trim(state) <> ''
  UNION ALL SELECT DISTINCT doc_id, 'year', CAST(year AS VARCHAR) FROM corpus WHERE year IS NOT NULL
  UNION ALL SELECT DISTINCT doc_id, 'technology_type', technology_type FROM extracted WHERE parse_ok AND technology_type IS NOT NULL AND doc_id IN (SELECT doc_id FROM corpus)),
counts AS (SELECT field_name, category, count(*) AS available FROM rows GROUP BY ALL)"""
SQL: dict[str, str] = {
    "p2_found": _AVAILABLE
    + """
SELECT DISTINCT t.plan_id, t.field_name, t.category
FROM sample_targets t LEFT JOIN counts c ON c.field_name = t.field_name AND c.category = t.category
WHERE coalesce(c.available, 0) < CAST(t.target_share AS DECIMAL(20, 10)) * t.sample_size OR coalesce(c.available, 0) < t.min_rows""",
    "p2_availability": _AVAILABLE
    + """,
targets AS (SELECT DISTINCT plan_id, sample_size, field_name, category, min_rows, CAST(target_share AS DECIMAL(20, 10)) * sample_size AS wanted FROM sample_targets)
SELECT t.plan_id, t.field_name, t.category, t.sample_size, t.min_rows, coalesce(c.available, 0) AS available,
  greatest(ceil(coalesce(wanted, 0))::BIGINT - coalesce(c.available, 0), coalesce(min_rows, 0) - coalesce(c.available, 0), 0)::BIGINT AS missing,
  coalesce(c.available, 0) >= coalesce(wanted, 0) AND coalesce(c.available, 0) >= coalesce(min_rows, 0) AS met
FROM targets t LEFT JOIN counts c ON c.field_name = t.field_name AND c.category = t.category""",
    "p6_agreement": f"""
WITH last AS (SELECT doc_id, annotator, arg_max({{'p': technology_present::VARCHAR, 't': technology_type, 'r': failure_role}}, (coalesce(labelled_at, TIMESTAMP '0001-01-01'), coalesce(technology_present::INT, -1), coalesce(list_position([{_TYPES}], {_CANON.format('technology_type')}), -1), coalesce(list_position([{_ROLES}], {_CANON.format('failure_role')}), -1))) AS v FROM annotations WHERE doc_id IS NOT NULL AND annotator IS NOT NULL GROUP BY ALL),
votes AS (SELECT doc_id, 'technology_present' AS field_name, v.p AS label FROM last UNION ALL SELECT doc_id, 'technology_type', {_CANON.format('v.t')} FROM last UNION ALL SELECT doc_id, 'failure_role', {_CANON.format('v.r')} FROM last),
kept AS (SELECT * FROM votes WHERE doc_id IN (SELECT doc_id FROM last GROUP BY 1 HAVING count(*) >= 3) AND (field_name = 'technology_present' AND label IS NOT NULL OR field_name = 'technology_type' AND label IN ({_TYPES}) OR field_name = 'failure_role' AND label IN ({_ROLES}))),
n AS (SELECT doc_id, field_name, label, count(*) AS k FROM kept GROUP BY ALL)
SELECT doc_id, field_name, sum(k)::BIGINT AS n_votes, round(CASE WHEN sum(k) > 1 THEN sum(k * (k - 1)) / (sum(k) * (sum(k) - 1)) END, 6) AS agreement FROM n GROUP BY ALL""",
    "p10_counts": r"""
WITH d AS (SELECT doc_id, regexp_replace(text, '[\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}\x{AD}]+', '', 'g') AS t FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, t, length(t) AS n, len(regexp_extract_all(t, '[^\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+')) AS k, length(regexp_replace(t, '[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]', '', 'g')) AS solid,
  length(regexp_replace(t, '[^\p{Nd}]', '', 'g')) AS digits, length(regexp_replace(t, '[^\p{L}]', '', 'g')) AS letters, [y FOR y IN regexp_split_to_array(t, '\r\n|[\r\n\x{85}\x{2028}\x{2029}]') IF regexp_matches(y, '\S')] AS lines FROM d)
SELECT doc_id, k::BIGINT AS n_tokens, n AS n_chars, round(least(40.0::DOUBLE, solid / k), 6) AS mean_word_length, round(digits / solid, 6) AS digit_ratio, round((solid - digits - letters) / n, 6) AS symbol_ratio,
  round(len([y FOR y IN lines IF regexp_matches(y, '[.!?:;…][\"''”’»)\]]*\s*$')]) / greatest(1, len(lines)), 6) AS end_punctuation FROM x WHERE k > 0""",
    "p7_found": r"""
WITH long AS (SELECT doc_id, narrative FROM corpus WHERE len(regexp_extract_all(narrative, '\S+')) > 400),
parts AS (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(narrative, '([.?!]["\x27”’»)\]}]?)\s+', '\1' || chr(10), 'g'), '[\n\r\v\f]+')) AS part FROM long)
SELECT doc_id, CASE WHEN max(len(regexp_extract_all(part, '\S+'))) > 400 THEN 'forced' ELSE 'natural' END AS cut FROM parts GROUP BY doc_id""",
}
