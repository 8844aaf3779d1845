"""Orphan references against brute force, and the defined cases."""

import datetime as dt
import random

from sievemark.functions.keys import day_key, facility_key, tag_key
from sievemark.operators.orphans import corpus_orphans, find_orphans, orphan_report
from sievemark.plans.core_queries import ORPHAN_TABLES
from sievemark.session import table

REFS = "ref_table string, key string, at timestamp_ntz, row int, block int, reason0 string"
PARENTS = "ref_table string, key string, valid_from timestamp_ntz, valid_to timestamp_ntz"


def day(n):
    return dt.datetime(2020, 1, 1) + dt.timedelta(days=n)


def brute(refs, parents):
    out = set()
    for r in refs:
        if r[1] is None:
            continue
        at = r[2] or dt.datetime(9999, 12, 30)
        mine = [p for p in parents if p[:2] == r[:2]]
        live = [p for p in mine if (p[2] is None or p[2] <= at) and (p[3] is None or p[3] > at)]
        if live:
            continue
        late = all(p[2] is not None and p[2] > at for p in mine)
        out.add((r[3], "missing" if not mine else "late" if late else "deleted"))
    return out


def test_brute_force(spark):
    r = random.Random(5)
    refs = [(r.choice("ab"), r.choice(["k1", "k2", "k3", "k4", "gone", None]), r.choice([None, *[day(r.randrange(900)) for _ in range(6)]]), i, 1, "x") for i in range(600)]
    parents = []
    for _ in range(40):
        a = r.choice([None, day(r.randrange(800))])
        parents.append((r.choice("ab"), r.choice(["k1", "k2", "k3", "k4"]), a, r.choice([None, (a or day(0)) + dt.timedelta(days=r.randrange(0, 300))])))
    parents += parents[:7]
    got = find_orphans(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS))
    assert {(x["row"], x["reason"]) for x in got.collect()} == brute(refs, parents)
    assert got.columns == ["ref_table", "key", "at", "row", "block", "reason0", "reason"]


def test_bounds_are_half_open(spark):
    refs = [("a", "k", day(10), 1, 0, ""), ("a", "k", day(20), 2, 0, ""), ("a", "k", day(9), 3, 0, "")]
    got = find_orphans(spark.createDataFrame(refs, REFS), spark.createDataFrame([("a", "k", day(10), day(20))], PARENTS))
    assert {(x["row"], x["reason"]) for x in got.collect()} == {(2, "deleted"), (3, "late")}


def test_hot_key_and_empty(spark):
    refs = spark.createDataFrame([("a", "hot" if i % 3 else f"k{i}", day(i % 400), i, 0, "") for i in range(900)], REFS)
    none = spark.createDataFrame([], PARENTS)
    assert find_orphans(refs, none).where("reason = 'missing'").count() == 900
    assert find_orphans(spark.createDataFrame([], REFS), none).count() == 0
    alive = spark.createDataFrame([("a", "hot", day(0), None)] * 50, PARENTS)
    assert find_orphans(refs, alive).count() == 300


def test_keys(spark):
    d = spark.createDataFrame([(" 15009 ", "f0689", "3/4/2020"), ("15a009", " F 0689", "2020-03-04"), ("0150099", "689", "2021-02-30"), ("  ", "000", ""), (None, None, None)], "c string, t string, d string")
    got = [tuple(r) for r in d.select(facility_key(d.c), tag_key(d.t), day_key(d.d)).collect()]
    assert got == [("015009", "F689", "2020-03-04"), ("15A009", "F689", "2020-03-04"), ("0150099", "F689", "2021-02-30"), (None, "F0", None), (None, None, None)]


def test_extra_columns_and_report(spark, data):
    tables = {t: table(spark, data, t) for t in ORPHAN_TABLES}
    plain = corpus_orphans(spark, tables)
    more = corpus_orphans(spark, {k: v.selectExpr("*", "1 as q", "2 as block", "'z' as reason", "0 as word") for k, v in tables.items()})
    assert plain.count() == more.count() > 0
    assert orphan_report(plain).agg({"n_orphans": "sum"}).first()[0] == plain.count()
