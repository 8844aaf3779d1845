"""Rejected lines against a reader written out by hand."""

import datetime as dt
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
import pyarrow as pa

from sievemark.operators.reject_rows import judge_lines, rejected_rows, split_rows, valid_rows

GOOD = '015009,2024-01-15,F689,"He said ""no"", twice",D,Y,TX'


def brute(line):
    line = (line or "")
    line = line[:-1] if line.endswith("\r") else line
    fields, i = [], 0
    while True:  # one field a turn
        if line[i : i + 1] == '"':
            m = re.compile(r'"((?:[^"]|"")*)"').match(line, i)
            if not m:
                return "quoting"
            fields.append(m.group(1).replace('""', '"'))
            i = m.end()
        else:
            j = line.find(",", i)
            raw = line[i:] if j < 0 else line[i:j]
            if '"' in raw:
                return "quoting"
            fields.append(raw)
            i += len(raw)
        if i >= len(line):
            break
        if line[i] != ",":
            return "quoting"
        i += 1
    if len(fields) != 7 or line == "":
        return "column_count"
    ccn, day, tag, text, sev, flag, state = (f.strip() for f in fields)
    try:
        ok_day = bool(re.fullmatch(r"\d{4}-\d{2}-\d{2}", day, re.A)) and bool(dt.date.fromisoformat(day))
    except ValueError:
        ok_day = False
    good = re.fullmatch(r"[A-Za-z0-9]{6}", ccn) and ok_day and re.fullmatch(r"[FK]\d{3,4}", re.sub(r"\s", "", tag).upper(), re.A) and text and "�" not in text
    good = good and re.fullmatch(r"[A-La-l]?", sev) and flag.lower() in ("", "y", "n", "true", "false", "1", "0") and re.fullmatch(r"([A-Za-z]{2})?", state)
    return None if good else "invalid_value"


def judge(lines):
    n = len(lines)
    return judge_lines(pa.array(range(n), pa.int64()), pa.array(["f"] * n), pa.array([2] * n, pa.int32()), pa.array(lines, pa.string())).column("reason").to_pylist()


CASES = [
    GOOD, GOOD + "\r", "", None, ",", '"a"b,1', 'a"b"', "a,b", GOOD + ",", '015009,2023-02-29,F689,x,D,Y,TX', '015009,2024-02-29,f 689,x,,,', '15009,2024-01-15,F689,x,D,Y,TX', '015009,2024-01-15,F68,x,D,Y,TX',
    '015009,2024-01-15,F689," ",D,Y,TX', '015009,2024-01-15,F689,x�y,D,Y,TX', '015009,2024-01-15,F689,x,M,Y,TX', '015009,2024-01-15,F689,x,D,maybe,TX', '015009,2024-01-15,F689,x,D,Y,T',
    '015009,2024-01-15,F689,"two\nlines",D,Y,TX', '015009,2024-01-15,F689,"a\r\nb, c",D,Y,TX', '"015009","2024-01-15","F689","x","D","","tx"', ' "015009",2024-01-15,F689,x,D,Y,TX', '015009,2024-01-15,F689,"open,D,Y,TX', "0000-01-01",
    '015009,0000-01-01,F689,x,D,Y,TX', '015009,2024-01-15,F689,' + "long " * 50000 + ',D,Y,TX',
]


def test_cases():
    assert judge(CASES) == [brute(c) for c in CASES]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet='",ab1 \r\n', max_size=14), min_size=1, max_size=6))
def test_random_lines(lines):
    assert judge(lines) == [brute(x) for x in lines]


def test_random_edits():
    r = random.Random(3)
    lines = []
    for _ in range(800):
        s = list(GOOD)
        for _ in range(r.randrange(3)):
            s[r.randrange(len(s))] = r.choice(['"', ",", "", "x", " ", "0"])
        lines.append("".join(s))
    assert judge(lines) == [brute(x) for x in lines]


def test_table(spark):
    rows = [(1, "a", 1, "ccn,survey_date"), (2, "a", 2, GOOD), (3, "a", 3, None), (4, "a", 4, GOOD), (4, "a", 4, GOOD), (5, None, None, GOOD), (6, "a", 6, "x,")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "raw_id bigint, file_name string, line_no int, raw_line string, reason string, ccn int")
    ok = valid_rows(df).collect()
    assert sorted(r["raw_id"] for r in ok) == [2, 4, 4, 5]
    assert ok[0]["survey_date"] == dt.date(2024, 1, 15) and ok[0]["narrative"] == 'He said "no", twice' and ok[0]["is_complaint"] is True
    assert {(r["raw_id"], r["reason"]) for r in rejected_rows(df).collect()} == {(3, "column_count"), (6, "column_count")}
    assert split_rows(df.limit(0)).count() == 0
