"""Rows that fail to parse.

Lines go through in Arrow batches. Quoting is judged per line with a linear-time pattern; the lines
left are read by the Arrow CSV reader, whose invalid-row callback takes the lines with a wrong number
of fields; fields stay text and are then cast column by column, and the first failing cell labels the
row. Everything is a map over lines: no shuffle, nothing collected, memory bounded by the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ("ccn", "survey_date", "f_tag", "narrative", "scope_severity", "is_complaint", "state")
_FIELD = r'(?:"(?:[^"]|"")*"|[^",]*)'
QUOTING = rf"\A{_FIELD}(?:,{_FIELD})*\z"
OUT = (
    "raw_id bigint, file_name string, line_no int, reason string, failed_field string, n_fields int, raw_line string, "
    "ccn string, survey_date date, f_tag string, narrative string, scope_severity string, is_complaint boolean, state string"
)
_ARROW = pa.schema([
    ("raw_id", pa.int64()), ("file_name", pa.string()), ("line_no", pa.int32()), ("reason", pa.string()), ("failed_field", pa.string()), ("n_fields", pa.int32()), ("raw_line", pa.string()),
    ("ccn", pa.string()), ("survey_date", pa.date32()), ("f_tag", pa.string()), ("narrative", pa.string()), ("scope_severity", pa.string()), ("is_complaint", pa.bool_()), ("state", pa.string()),
])
_SHIFT = "\x10"  #: stands before the letter of a line break, or of itself, while the reader runs
_CODES = ((_SHIFT, _SHIFT + "d"), ("\n", _SHIFT + "n"), ("\r", _SHIFT + "r"))


def _unbroken(text: pa.Array) -> pa.Array:
    """Texts without line breaks; ``_broken`` gives them back, whatever characters they hold."""
    for plain, code in _CODES:
        text = pc.replace_substring(text, plain, code)
    return text


def _broken(text: pa.Array) -> pa.Array:
    for plain, code in reversed(_CODES):
        text = pc.replace_substring(text, code, plain)
    return text


def _days(text: pa.Array) -> pa.Array:
    """Real ``yyyy-mm-dd`` days as dates, others null, without the reader's leniency for day 31."""
    parts = pc.extract_regex(text, r"\A(?P<y>\d{4})-(?P<m>\d{2})-(?P<d>\d{2})\z")
    y, m, d = (pc.cast(pc.struct_field(parts, k), pa.int32()) for k in ("y", "m", "d"))
    leap = pc.and_(pc.equal(_mod(y, 4), 0), pc.or_(pc.not_equal(_mod(y, 100), 0), pc.equal(_mod(y, 400), 0)))
    long = pc.is_in(m, pa.array([1, 3, 5, 7, 8, 10, 12], pa.int32()))
    last = pc.if_else(long, 31, pc.if_else(pc.equal(m, 2), pc.if_else(leap, 29, 28), 30))
    good = pc.and_(pc.and_(pc.greater(y, 0), pc.and_(pc.greater_equal(m, 1), pc.less_equal(m, 12))), pc.and_(pc.greater_equal(d, 1), pc.less_equal(d, last)))
    return pc.cast(pc.if_else(pc.fill_null(good, False), text, None), pa.date32())


def _mod(a: pa.Array, n: int) -> pa.Array:
    return pc.subtract(a, pc.multiply(pc.divide(a, n), n))


def _matches(text: pa.Array, pattern: str) -> pa.Array:
    return pc.fill_null(pc.match_substring_regex(text, pattern), False)


def judge_lines(raw_id: pa.Array, file_name: pa.Array, line_no: pa.Array, raw_line: pa.Array) -> pa.Table:
    """Typed columns and reason of lines that are no header. A null line is an empty line."""
    n = len(raw_line)
    line = pc.replace_substring_regex(pc.fill_null(raw_line, ""), r"\r\z", "")
    reason, field, n_fields = [None] * n, [None] * n, [None] * n
    quoted = _matches(line, QUOTING).to_numpy(zero_copy_only=False)
    for i in (~quoted).nonzero()[0]:
        reason[i] = "quoting"
    flat = _unbroken(line).filter(pa.array(quoted))
    numbered = "\n".join(pc.binary_join_element_wise(pc.cast(pa.array(quoted.nonzero()[0]), flat.type), flat, ",").to_pylist())
    rejected: dict[int, int] = {}

    def invalid(row: csv.InvalidRow) -> str:
        rejected[int(row.text.split(",", 1)[0])] = row.actual_columns - 1
        return "skip"

    names = ["_i", *FIELDS]
    if numbered:
        data = numbered.encode()
        parsed = csv.read_csv(
            pa.BufferReader(data),
            read_options=csv.ReadOptions(column_names=names, use_threads=False, block_size=max(1 << 20, len(data) + 1)),
            parse_options=csv.ParseOptions(invalid_row_handler=invalid, newlines_in_values=False),
            convert_options=csv.ConvertOptions(column_types={k: pa.string() for k in names}, strings_can_be_null=False),
        )
    else:
        parsed = pa.table({k: pa.array([], pa.string()) for k in names})
    # one array for each field: some kernels fail on a column without chunks, which is what all-invalid lines leave
    parsed = {k: pa.concat_arrays(parsed[k].chunks) if parsed[k].num_chunks else pa.array([], pa.string()) for k in names}
    for i, k in rejected.items():
        reason[i], n_fields[i] = "column_count", k
    at = pc.cast(parsed["_i"], pa.int64())
    cols = {}
    for k in FIELDS:
        cols[k] = pc.utf8_trim_whitespace(_broken(parsed[k]))
    tag = pc.utf8_upper(pc.replace_substring_regex(cols["f_tag"], r"\s", ""))
    day = _days(cols["survey_date"])
    flag = pc.utf8_lower(cols["is_complaint"])
    good = {
        "ccn": _matches(cols["ccn"], r"\A[A-Za-z0-9]{6}\z"),
        "survey_date": pc.is_valid(day),
        "f_tag": _matches(tag, r"\A[FK]\d{3,4}\z"),
        "narrative": pc.and_(pc.not_equal(cols["narrative"], ""), pc.invert(pc.match_substring(cols["narrative"], "�"))),
        "scope_severity": _matches(cols["scope_severity"], r"\A[A-La-l]?\z"),
        "is_complaint": _matches(flag, r"\A(?:y|n|true|false|1|0)?\z"),
        "state": _matches(cols["state"], r"\A(?:[A-Za-z]{2})?\z"),
    }
    places = at.to_pylist()
    for k in reversed(FIELDS):  # the first failing field has the last word
        for j in (~good[k].to_numpy(zero_copy_only=False).astype(bool)).nonzero()[0]:
            reason[places[j]], field[places[j]] = "invalid_value", k
    for p in places:
        n_fields[p] = len(FIELDS)
    blank = lambda c: pc.if_else(pc.equal(c, ""), None, c)
    typed = {
        "ccn": pc.utf8_upper(cols["ccn"]), "survey_date": day, "f_tag": tag, "narrative": cols["narrative"], "scope_severity": pc.utf8_upper(blank(cols["scope_severity"])),
        "is_complaint": pc.if_else(pc.equal(flag, ""), None, pc.is_in(flag, pa.array(["y", "true", "1"]))), "state": pc.utf8_upper(blank(cols["state"])),
    }
    reason_a = pa.array(reason, pa.string())
    where = pa.array([None] * n, pa.int64()).to_pylist()
    for j, p in enumerate(places):
        if reason[p] is None:
            where[p] = j
    take = pa.array(where, pa.int64())
    out = {"raw_id": raw_id, "file_name": file_name, "line_no": line_no, "reason": reason_a, "failed_field": pa.array(field, pa.string()), "n_fields": pa.array(n_fields, pa.int32()), "raw_line": pc.if_else(pc.is_valid(reason_a), raw_line, pa.scalar(None, pa.string()))}
    for k in FIELDS:
        out[k] = typed[k].take(take)
    return pa.table(out).cast(_ARROW)


def split_rows(lines: DataFrame, batch_bytes: int = 8 << 20) -> DataFrame:
    """Valid rows typed (reason null) and rejected rows with their reason, in one table.

    ``lines``: raw_id, file_name, line_no, raw_line; other columns are ignored. Line 1 of a file is its
    header and is dropped. reason is the first that applies of quoting, column_count and invalid_value
    (then failed_field names the first failing field); a rejected row keeps its raw_line. Repeated lines
    are judged each; an empty table gives an empty table. ``batch_bytes`` bounds what is parsed at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            step = max(1, int(b.num_rows * batch_bytes / max(1, b.nbytes)))
            for i in range(0, b.num_rows, step):
                part = b.slice(i, step)
                columns = [pa.concat_arrays([part.column(k)]) for k in ("raw_id", "file_name", "line_no", "raw_line")]
                yield from judge_lines(*[c.cast(t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int32(), pa.string()))]).to_batches()

    body = lines.where(F.coalesce(F.col("line_no") != 1, F.lit(True))).select(F.col("raw_id").cast("bigint"), "file_name", F.col("line_no").cast("int"), "raw_line")
    return body.mapInArrow(run, OUT)


def valid_rows(lines: DataFrame) -> DataFrame:
    return split_rows(lines).where("reason is null").drop("reason", "failed_field", "n_fields", "raw_line")


def rejected_rows(lines: DataFrame) -> DataFrame:
    return split_rows(lines).where("reason is not null").select("raw_id", "file_name", "line_no", "reason", "failed_field", "n_fields", "raw_line")
