import datetime as dt
import json

from pyspark.sql import functions as F

from sievemark.operators.schema_drift import field_statistics, path_statistics, schema_changes, unified_records

SCHEMA = "feed string, file_name string, released_at timestamp_ntz, position int, payload string, loaded_at timestamp_ntz, field string, n int"


def files(spark, *contents):
    rows = [("f", f"file_{i}", dt.datetime(2020, 1, 1 + i), p, json.dumps(x) if isinstance(x, dict) else x, None, "clash", 1) for i, xs in enumerate(contents) for p, x in enumerate(xs)]
    return spark.createDataFrame(rows, SCHEMA)


def changes(df):
    return {(r["file_name"], r["field_name"], r["change_kind"]) for r in schema_changes(df).collect()}


def recs(n=20, **f):
    return [{k: v(i) if callable(v) else v for k, v in f.items()} for i in range(n)]


def test_each_kind(spark):
    ccn = lambda i: f"{100000 + i}"
    a = recs(ccn=ccn, state=lambda i: "TXCA"[2 * (i % 2) :][:2], ss=lambda i: "D", old=lambda i: f"2020-01-{i + 1:02d}")
    b = recs(**{" CCN ": ccn, "St Cd": lambda i: "TXCA"[2 * (i % 2) :][:2], "ss": lambda i: 4, "team": lambda i: i % 5 + 2})
    assert changes(files(spark, a, b)) == {("file_1", "st_cd", "renamed"), ("file_1", "ss", "retyped"), ("file_1", "old", "removed"), ("file_1", "team", "added")}


def test_share_and_types(spark):
    a = recs(40, x=1)
    stray = [{"x": 1, **({"y": "s"} if i < 3 else {})} for i in range(40)]  # under a tenth
    tenth = [{"x": "1" if i < 5 else 1, **({"y": "s"} if i < 4 else {})} for i in range(40)]
    nulls = recs(40, x=None, y="s")
    assert changes(files(spark, a, stray)) == set()
    assert changes(files(spark, a, tenth)) == {("file_1", "y", "added")}
    assert changes(files(spark, tenth, nulls)) == set()  # no non-null value, so no type


def test_order_follows_release_and_feeds_are_apart(spark):
    df = files(spark, recs(x=1), recs(x=1, y="a b"))
    late = df.selectExpr("feed", "case file_name when 'file_0' then 'zz' else 'aa' end as file_name", "released_at", "position", "payload", "loaded_at")
    assert changes(late) == {("aa", "y", "added")}
    assert changes(df.selectExpr("file_name as feed", "file_name", "released_at", "position", "payload")) == set()


def test_bad_payloads_and_empty(spark):
    df = files(spark, ["not json", "[1, 2]", None, {"ccn": "1"}, {"ccn": "1"}])
    assert changes(df) == set()
    u = {r["position"]: r for r in unified_records(df).collect()}
    assert len(u) == 5 and u[0]["ccn"] is None and u[0]["failed_casts"][0]["column"] == "payload" and u[3]["ccn"] == "1"
    assert schema_changes(df.limit(0)).count() == 0 and unified_records(df.limit(0)).count() == 0


def test_unified_types(spark):
    a = recs(is_complaint=True, survey_date="2020-01-02", state="TX", note="x")
    b = recs(flag="Y", survey_date="2020-01-03", state="TX", note="x")
    c = [{"flag": "maybe", "survey_date": 7, "state": "TX"}, *recs(flag="N", survey_date="2020-01-03", state="TX")]
    u = unified_records(files(spark, a, b, c)).collect()
    assert {r["is_complaint"] for r in u} == {True, False, None}
    bad = next(r for r in u if r["file_name"] == "file_2" and r["position"] == 0)
    assert {(x["column"], x["value"]) for x in bad["failed_casts"]} == {("is_complaint", "maybe"), ("survey_date", "7")}
    assert u[0]["extra"] == {"note": "x"}


def test_text_columns_name_what_does_not_fit(spark):
    ok = {"ccn": "01500A", "f_tag": "f 689", "scope_severity": " d ", "state": "tx", "narrative": "[1] fell"}
    cell = {**ok, "scope_severity": {"severity": 2, "scope": 1}}
    bad = {"ccn": "unknown", "f_tag": ["F689"], "scope_severity": {"severity": 9, "scope": 1}, "state": 7, "narrative": {"text": "x"}}
    u = {r["position"]: r for r in unified_records(files(spark, [ok, cell, bad, {**ok, "scope_severity": 3}, {**ok, "scope_severity": ""}])).collect()}
    assert not u[0]["failed_casts"] and u[0]["scope_severity"] == " d " and u[0]["narrative"] == "[1] fell"
    assert u[1]["scope_severity"] == "D" and not u[1]["failed_casts"]
    assert {x["column"] for x in u[2]["failed_casts"]} == set(bad) and all(u[2][k] is None for k in bad)
    assert [tuple(x) for x in u[3]["failed_casts"]] == [("scope_severity", "3")] and not u[4]["failed_casts"]


def test_inner_paths(spark):
    got = {(r["path"], r["raw_type"]): r["n"] for r in path_statistics(files(spark, [{"ss": {"Severity": 2, "a": [{"b": None}, "x"]}}, {"ss": "D"}])).collect()}
    assert got == {("ss", "object"): 1, ("ss", "string"): 1, ("ss.severity", "number"): 1, ("ss.a", "array"): 1, ("ss.a[]", "object"): 1, ("ss.a[]", "string"): 1, ("ss.a[].b", "null"): 1}


def test_change_inside_an_object(spark):
    a = recs(ss=lambda i: {"severity": 2, "note": {"by": "x"}}, t=lambda i: [{"k": 1}])
    b = recs(ss=lambda i: {"severity": "two", "note": {"who": "x"}, "more": 1}, t=lambda i: [{"k": "1"}])
    got = {(r["field_name"], r["change_kind"], r["old_name"], r["depth"]) for r in schema_changes(files(spark, a, b)).collect()}
    assert got == {("ss.severity", "retyped", None, 1), ("ss.more", "added", None, 1), ("ss.note.who", "renamed", "ss.note.by", 2), ("t[].k", "retyped", None, 2)}


def test_free_short_text_is_renamed_and_its_statistics_are_bounded(spark):
    a = recs(500, ccn=lambda i: f"{100000 + i}", room=lambda i: f"ward {chr(97 + i % 26)}{chr(97 + i // 26)}x east", team=lambda i: ["red", "blue"][i % 2])
    b = recs(500, ccn=lambda i: f"{100000 + i}", place=lambda i: f"hall {chr(97 + i % 26)}{chr(97 + i // 26)}y west", crew=lambda i: ["green", "white"][i % 2])
    df = files(spark, a, b)
    assert changes(df) == {("file_1", "place", "renamed"), ("file_1", "team", "removed"), ("file_1", "crew", "added")}
    assert field_statistics(df).groupBy("file_name", "field").count().agg({"count": "max"}).first()[0] <= 64


def test_unknown_first_name_gets_its_column_by_content(spark):
    row = dict(facility_number=lambda i: f"{100000 + i}", visited=lambda i: f"2019-11-{i + 1:02d}", cite=lambda i: f"F{600 + i}", found=lambda i: f"The alarm of room {i} was silent for an hour.", grid=lambda i: "DEFG"[i % 4], hotline=lambda i: bool(i % 2), where=lambda i: "TXCANYFL"[2 * (i % 4) :][:2])
    u = unified_records(files(spark, recs(beds=lambda i: 40 + i % 30, **row))).collect()
    r = next(x for x in u if x["position"] == 3)
    assert (r["ccn"], str(r["survey_date"]), r["f_tag"], r["scope_severity"], r["is_complaint"], r["state"]) == ("100003", "2019-11-04", "F603", "G", True, "FL") and r["narrative"].startswith("The alarm") and r["extra"] == {"beds": "43"}
    # values unlike those of the field elsewhere do not take its place
    other = recs(ccn=lambda i: f"{100000 + i}", shift=lambda i: ["am", "pm"][i % 2])
    df = files(spark, other).withColumn("feed", F.lit("g")).unionByName(files(spark, recs(60, **{**row, "state": row["where"]})))
    assert {r["state"] for r in unified_records(df).where("feed = 'g'").collect()} == {None}
    # nor does a key that stands beside the field in another file
    flags = dict(is_complaint=lambda i: bool(i % 2), on_file=lambda i: bool(i % 3))
    df = files(spark, recs(**flags), recs(on_file=flags["on_file"]))
    assert {r["is_complaint"] for r in unified_records(df).where("file_name = 'file_1'").collect()} == {None}


def test_files_of_one_feed_are_compared_apart(spark):
    df = files(spark, *[recs(3, **{"x": 1, f"k{i // 2}": "some words"}) for i in range(12)])
    assert changes(df) == {(f"file_{i}", f"k{i // 2}", "renamed") for i in range(2, 12, 2)}
    assert "FlatMapGroupsInPandas" not in schema_changes(df)._jdf.queryExecution().toString()
