"""ANSI SQL of the general data-quality queries, as DuckDB runs them."""

_KEYS = """
keys_corpus AS (
  SELECT doc_id, year, quarter, loaded_at,
         CASE WHEN trim(ccn) <> '' THEN lpad(upper(trim(ccn)), greatest(6, length(trim(ccn)))::INT, '0') END AS ccn,
         CASE WHEN regexp_matches(upper(regexp_replace(f_tag, '\\s+', '', 'g')), '^[A-Z]?0*[0-9]+$')
              THEN coalesce(nullif(regexp_extract(upper(regexp_replace(f_tag, '\\s+', '', 'g')), '^([A-Z]?)0*([0-9]+)$', 1), ''), 'F')
                   || regexp_extract(upper(regexp_replace(f_tag, '\\s+', '', 'g')), '^([A-Z]?)0*([0-9]+)$', 2)
              ELSE nullif(upper(regexp_replace(f_tag, '\\s+', '', 'g')), '') END AS tag,
         CASE WHEN regexp_matches(trim(survey_date), '^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$')
              THEN split_part(trim(survey_date), '/', 3) || '-' || lpad(split_part(trim(survey_date), '/', 1), 2, '0') || '-' || lpad(split_part(trim(survey_date), '/', 2), 2, '0')
              ELSE nullif(trim(survey_date), '') END AS day,
         nullif(substr(upper(trim(scope_severity)), 1, 1), '') AS letter
  FROM corpus),
refs AS (
  SELECT doc_id, year, quarter, loaded_at, 'provider_information' AS ref_table, ccn AS key FROM keys_corpus WHERE ccn IS NOT NULL
  UNION ALL SELECT doc_id, year, quarter, loaded_at, 'tag_taxonomy', tag FROM keys_corpus WHERE tag IS NOT NULL
  UNION ALL SELECT doc_id, year, quarter, loaded_at, 'health_deficiencies', ccn || '|' || day || '|' || tag FROM keys_corpus WHERE ccn IS NOT NULL AND day IS NOT NULL AND tag IS NOT NULL
  UNION ALL SELECT doc_id, year, quarter, loaded_at, 'severity_grid', letter FROM keys_corpus WHERE letter IS NOT NULL),
parents AS (
  SELECT 'provider_information' AS ref_table, lpad(upper(trim(cms_certification_number_ccn)), greatest(6, length(trim(cms_certification_number_ccn)))::INT, '0') AS key, loaded_at AS a, deleted_at AS b FROM provider_information
  UNION ALL
  SELECT 'tag_taxonomy', coalesce(nullif(regexp_extract(upper(regexp_replace(f_tag, '\\s+', '', 'g')), '^([A-Z]?)0*([0-9]+)$', 1), ''), 'F') || regexp_extract(upper(regexp_replace(f_tag, '\\s+', '', 'g')), '^([A-Z]?)0*([0-9]+)$', 2), loaded_at, deleted_at FROM tag_taxonomy
  UNION ALL
  SELECT 'health_deficiencies', lpad(upper(trim(cms_certification_number_ccn)), greatest(6, length(trim(cms_certification_number_ccn)))::INT, '0') || '|' ||
         CASE WHEN regexp_matches(trim(survey_date), '^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$')
              THEN split_part(trim(survey_date), '/', 3) || '-' || lpad(split_part(trim(survey_date), '/', 1), 2, '0') || '-' || lpad(split_part(trim(survey_date), '/', 2), 2, '0')
              ELSE trim(survey_date) END || '|' ||
         coalesce(nullif(regexp_extract(upper(regexp_replace(deficiency_tag_number, '\\s+', '', 'g')), '^([A-Z]?)0*([0-9]+)$', 1), ''), 'F') || regexp_extract(upper(regexp_replace(deficiency_tag_number, '\\s+', '', 'g')), '^([A-Z]?)0*([0-9]+)$', 2),
         loaded_at, deleted_at FROM health_deficiencies
  UNION ALL SELECT 'severity_grid', substr(upper(trim(scope_severity)), 1, 1), NULL, NULL FROM severity_grid),
judged AS (
  SELECT r.doc_id, r.year, r.quarter, r.ref_table, r.key,
         count(p.key) AS n_rows,
         coalesce(bool_or((p.a IS NULL OR p.a <= r.loaded_at) AND (p.b IS NULL OR p.b > r.loaded_at)), false) AS answered,
         bool_or(p.a IS NULL OR p.a <= r.loaded_at) AS had_come
  FROM refs r LEFT JOIN (SELECT DISTINCT * FROM parents) p ON p.ref_table = r.ref_table AND p.key = r.key
  GROUP BY ALL),
orphans AS (
  SELECT doc_id, year, quarter, ref_table, key, CASE WHEN n_rows = 0 THEN 'missing' WHEN NOT had_come THEN 'late' ELSE 'deleted' END AS reason
  FROM judged WHERE n_rows = 0 OR NOT answered)
"""

P3_FOUND = f"WITH {_KEYS} SELECT DISTINCT doc_id, ref_table, reason FROM orphans"
P3_REPORT = f"WITH {_KEYS} SELECT ref_table, year, quarter, reason, count(*)::BIGINT AS n_orphans, count(DISTINCT key)::BIGINT AS n_keys FROM orphans GROUP BY ALL"

_P5 = r"""
WITH l AS (SELECT raw_id, file_name, line_no, regexp_replace(coalesce(raw_line, ''), '\r$', '') AS line FROM raw_lines WHERE line_no <> 1 OR line_no IS NULL),
f AS (SELECT *, regexp_full_match(line, '(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*') AS quoted,
        [regexp_replace(CASE WHEN starts_with(x, '"') THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END, '^\s+|\s+$', '', 'g') FOR x IN regexp_extract_all(',' || line, ',("(?:[^"]|"")*"|[^",]*)', 1)] AS p FROM l),
c AS (SELECT raw_id, file_name, line_no, quoted, len(p) AS n, p[1] AS ccn, p[2] AS survey_date, upper(regexp_replace(p[3], '\s', '', 'g')) AS f_tag, p[4] AS narrative, upper(p[5]) AS scope_severity, lower(p[6]) AS flag, upper(p[7]) AS state FROM f),
judged AS (SELECT *, CASE WHEN NOT quoted THEN 'quoting' WHEN n <> 7 THEN 'column_count'
  WHEN NOT (regexp_full_match(ccn, '[A-Za-z0-9]{6}') AND regexp_full_match(survey_date, '\d{4}-\d{2}-\d{2}') AND TRY_CAST(survey_date AS DATE) IS NOT NULL AND regexp_full_match(f_tag, '[FK]\d{3,4}')
    AND narrative <> '' AND NOT contains(narrative, chr(65533)) AND regexp_full_match(scope_severity, '[A-L]?') AND flag IN ('', 'y', 'n', 'true', 'false', '1', '0') AND regexp_full_match(state, '([A-Z]{2})?')) THEN 'invalid_value' END AS reason FROM c)
"""
P5_FOUND = _P5 + "SELECT DISTINCT raw_id, reason FROM judged WHERE reason IS NOT NULL"
P5_VALID = (
    _P5
    + """SELECT raw_id, file_name, line_no::INT AS line_no, upper(ccn) AS ccn, survey_date, f_tag, narrative, nullif(scope_severity, '') AS scope_severity,
  CASE WHEN flag <> '' THEN flag IN ('y', 'true', '1') END AS is_complaint, nullif(state, '') AS state FROM judged WHERE reason IS NULL"""
)

P4_PATHS = """
WITH r AS (SELECT row_number() OVER () AS rid, feed, file_name, payload FROM archive_records WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'),
t AS (SELECT r.rid, r.feed, r.file_name, j.id, j.parent, j.type, regexp_replace(lower(trim(j.key)), '\\s', '_', 'g') AS name FROM r, json_tree(r.payload) j),
p AS (
  SELECT feed, file_name, name AS path, type FROM t WHERE parent = 0
  UNION ALL SELECT c.feed, c.file_name, q.name || CASE WHEN q.type = 'ARRAY' THEN '[]' ELSE '.' || c.name END, c.type FROM t c JOIN t q ON q.rid = c.rid AND q.id = c.parent AND q.parent = 0)
SELECT feed, file_name, path, CASE type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'NULL' THEN 'null' ELSE 'number' END AS raw_type, count(*)::BIGINT AS n FROM p GROUP BY ALL
"""
