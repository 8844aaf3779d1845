import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sievemark.llm.sampling import category_counts, corpus_categories, corpus_rows, draw_samples, fit_cells, sample_report, target_shortfalls
from sievemark.operators.stratified import largest_remainder
from sievemark.session import table


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.integers(0, 30), st.integers(0, 300)), min_size=1, max_size=8), st.integers(0, 400))
def test_quota(cats, total):
    w, f, c = ([x[i] for x in cats] for i in range(3))
    q = largest_remainder(w, total, f, c)
    floors = [min(a, b) for a, b in zip(f, c)]
    assert all(a <= b <= m for a, b, m in zip(floors, q, c))
    if sum(floors) <= total:
        assert sum(q) <= total
        if all(x > 1e-3 for x in w):
            assert sum(q) == min(total, sum(c))


def test_quota_plain():
    assert largest_remainder([0.5, 0.3, 0.2], 10, [0] * 3, [99] * 3) == [5, 3, 2]
    assert largest_remainder([1, 1, 1], 10, [0] * 3, [99] * 3) == [4, 3, 3]
    assert largest_remainder([0.9, 0.1], 10, [0, 3], [99, 99]) == [7, 3]
    assert largest_remainder([0.9, 0.1], 10, [0, 0], [4, 99]) == [4, 6]


def test_cells():
    counts = np.array([[50, 10], [10, 50]])
    q = fit_cells(counts, [np.array([20, 10]), np.array([15, 15])], 30)
    assert q.sum() == 30 and (q <= counts).all() and abs(q.sum(1) - [20, 10]).max() <= 1 and abs(q.sum(0) - [15, 15]).max() <= 1


def test_whole(spark, data):
    corpus, extracted, targets = (table(spark, data, t) for t in ("corpus", "extracted", "sample_targets"))
    rows = corpus_rows(corpus, extracted)
    s = draw_samples(rows, targets)
    got = {tuple(r) for r in s.collect()}
    assert got == {tuple(r) for r in draw_samples(rows.repartition(9), targets).collect()}
    assert len({(r[0], r[1]) for r in got}) == len(got)
    sizes = {r["plan_id"]: r["sample_size"] for r in targets.collect()}
    for p, n in sizes.items():
        assert sum(r[0] == p for r in got) <= n
    rep = sample_report(s, targets, category_counts(corpus_categories(corpus, extracted)), rows).collect()
    assert len(rep) == targets.count()
    for r in rep:
        assert r["drawn"] <= r["drawable"] <= r["available"]
        assert r["met"] == (r["drawn"] >= r["wanted"] - 1e-9 and r["drawn"] >= (r["min_rows"] or 0)) == (r["reason"] is None)
        assert r["drawn"] == sum(x[0] == r["plan_id"] and x[s.columns.index(r["field_name"])] == r["category"] for x in got)
        if r["short_of_minimum"] and r["drawable"] >= r["min_rows"]:  # a minimum is given up only where all of them cannot be kept, or by a field whose own cannot
            assert r["reason"] in ("floors", "joint")


def test_edges(spark):
    t = "plan_id int, sample_size int, field_name string, category string, target_share double, min_rows int, available int"
    targets = spark.createDataFrame([(1, 10, "state", "TX", 0.5, 3, 0), (1, 10, "state", "CA", 0.5, None, 0), (1, 10, "state", "CA", 0.5, None, 0), (2, 4, "state", "NY", None, 1, 0), (3, 100, "state", "TX", 0.07, 0, 0)], t)
    c = spark.createDataFrame([(f"d{i}", " tx" if i < 7 else "CA" if i < 11 else None, 2020, 1) for i in range(14)] + [("d0", "TX", 2020, 1)], "doc_id string, state string, year bigint, category int")
    e = spark.createDataFrame([("d0", True, "none", 0.5), ("d0", True, "other", 0.9), ("d1", False, "none", 0.9), ("d2", True, None, None)], "doc_id string, parse_ok boolean, technology_type string, confidence double")
    counts = category_counts(corpus_categories(c, e))
    got = {(r["plan_id"], r["category"]): (r["available"], r["met"], r["missing"]) for r in target_shortfalls(targets, counts).collect()}
    assert got == {(1, "TX"): (7, True, 0), (1, "CA"): (4, False, 1), (2, "NY"): (0, False, 1), (3, "TX"): (7, True, 0)}
    rows = corpus_rows(c, e)
    assert {r["doc_id"]: r["technology_type"] for r in rows.collect()}["d0"] == "other"
    s = draw_samples(rows, targets).collect()
    assert sorted((r["plan_id"], r["state"]) for r in s if r["plan_id"] == 1) == [(1, "CA")] * 4 + [(1, "TX")] * 6
    assert draw_samples(rows, targets.limit(0)).count() == 0 and draw_samples(rows.limit(0), targets).count() == 0


def test_floors_survive_rounding():
    r = np.random.default_rng(4)
    counts = r.poisson(np.outer(np.outer(r.gamma(0.7, 1, 40), r.gamma(1, 1, 10)), r.gamma(1, 1, 11)).reshape(40, 10, 11) * 6)
    margins, floors = [], []
    for a in range(3):
        caps = counts.sum(axis=tuple(i for i in range(3) if i != a))
        least = np.minimum(caps, [20, 20, 20][a])
        floors.append(least)
        margins.append(np.array(largest_remainder(caps.tolist(), 1000, least.tolist(), caps.tolist())))
    q = fit_cells(counts, margins, 1000, floors=floors)
    assert q.sum() == 1000 and (q <= counts).all() and (q >= 0).all()
    for a in range(3):
        assert (q.sum(axis=tuple(i for i in range(3) if i != a)) >= floors[a]).all(), a
    # sums of margins that differ: no more than the total, and the other field keeps its floors
    q = fit_cells(np.full((3, 2), 50), [np.array([3, 7]).repeat([1, 2]), np.array([30, 30])], 10, floors=[np.array([3, 3, 3]), np.array([30, 30])])
    assert q.sum() == 10 and (q.sum(1) >= 3).all()


def test_report_says_what_was_missed_and_why(spark):
    target = "plan_id int, sample_size int, field_name string, category string, target_share double, min_rows int"
    rows = spark.createDataFrame([(f"t{i}", "TX", "2020") for i in range(9)] + [(f"c{i}", "CA", "2021") for i in range(9)], "doc_id string, state string, year string")
    counts = category_counts(rows.selectExpr("doc_id", "stack(2, 'state', state, 'year', year) as (field_name, category)"))

    def report(*targets):
        t = spark.createDataFrame([(1, *x) for x in targets], target)
        s = draw_samples(rows, t)
        return {r["category"]: (r["drawn"], r["met"], r["reason"], r["short_of_minimum"]) for r in sample_report(s, t, counts, rows).collect()}

    assert report((4, "state", "TX", 0.5, 2), (4, "state", "CA", 0.5, 2)) == {"TX": (2, True, None, 0), "CA": (2, True, None, 0)}
    assert report((4, "state", "TX", 0.5, 2), (4, "state", "CA", 0.5, 2), (4, "year", "2020", 1.0, 4)) == {"TX": (4, True, None, 0), "CA": (0, False, "joint", 2), "2020": (4, True, None, 0)}
    assert report((4, "state", "TX", 0.5, 4), (4, "state", "CA", 0.5, 4)) == {"TX": (2, False, "floors", 2), "CA": (2, False, "floors", 2)}
    assert report((5, "state", "TX", 0.9, 0), (5, "state", "CA", 0.1, 3)) == {"TX": (2, False, "floors_of_others", 0), "CA": (3, True, None, 0)}
    assert report((5, "state", "TX", 0.5, 0), (5, "state", "CA", 0.5, 0)) == {"CA": (3, True, None, 0), "TX": (2, False, "rounding", 0)}
    assert report((30, "state", "TX", 0.5, 0), (30, "state", "CA", 0.5, 9)) == {"TX": (9, False, "available", 0), "CA": (9, False, "available", 0)}
