import datetime as dt
import random

import pytest

from sievemark.llm.consensus import LABELS, TECHNOLOGY_TYPES, annotator_consensus, chi2_quantile, latest_votes

SCHEMA = "doc_id string, annotator int, technology_present boolean, technology_type string, failure_role string, labelled_at timestamp_ntz, label string, w double"
T0 = dt.datetime(2024, 1, 1)


def test_quantile():
    assert chi2_quantile(0.025, 1) == pytest.approx(0.000982, rel=1e-2)
    assert chi2_quantile(0.025, 10) == pytest.approx(3.247, rel=1e-3) and chi2_quantile(0.025, 100) == pytest.approx(74.22, rel=1e-3)
    assert chi2_quantile(0.025, 3000) == pytest.approx(2850.0, rel=2e-3)
    assert chi2_quantile(0.975, 10) == pytest.approx(20.483, rel=1e-4) and chi2_quantile(1 - 1e-6, 7) == pytest.approx(40.52, rel=1e-3)
    for k in (1, 2, 7, 500, 2000, 2001, 10**6):  # no seam, and close to the cube-root normal form where that is good
        q = chi2_quantile(0.025, k)
        assert chi2_quantile(0.025, k + 1) > q
        if k >= 500:
            assert q == pytest.approx(k * (1 - 2 / (9 * k) - 1.959964 * (2 / (9 * k)) ** 0.5) ** 3, rel=1e-4)


def test_bad_annotators_are_found(spark):
    r = random.Random(2)
    error = {1: 0.03, 2: 0.05, 3: 0.08, 4: 0.6, 5: 0.6, 6: 0.7, 7: 0.9}
    truth, rows = {}, []
    for i in range(400):
        truth[f"d{i}"] = r.choice(TECHNOLOGY_TYPES[:6])
        for a in r.sample(sorted(error), 5):
            label = truth[f"d{i}"] if r.random() > error[a] else r.choice([x for x in TECHNOLOGY_TYPES if x != truth[f"d{i}"]])
            rows.append((f"d{i}", a, True, label.upper().replace("_", " "), None, T0, "clash", 1.0))
    c, rel = annotator_consensus(spark.createDataFrame(rows, SCHEMA))
    got = {x["doc_id"]: x["label"] for x in c.where("field_name = 'technology_type'").collect()}
    right = sum(got[k] == v for k, v in truth.items()) / len(truth)
    plain = 0
    for k, v in truth.items():
        votes = [x[3].lower().replace(" ", "_") for x in rows if x[0] == k]
        plain += max(sorted(set(votes)), key=votes.count) == v
    assert right > 0.93 and right > plain / len(truth)
    w = {x["annotator"]: x["weight"] for x in rel.where("field_name = 'technology_type'").collect()}
    assert min(w[1], w[2], w[3]) > 2 * max(w[4], w[5], w[6], w[7])


def test_votes(spark):
    rows = [
        ("a", 1, True, "none", "absent", T0, "", 0.0), ("a", 1, False, " Call_Light", "absent", T0 + dt.timedelta(1), "", 0.0), ("a", 1, False, " Call_Light", "absent", T0 + dt.timedelta(1), "", 0.0),
        ("a", 2, None, "call light", None, T0, "", 0.0), ("a", 3, True, "toaster", "absent", None, "", 0.0), ("b", 1, True, "none", "none", T0, "", 0.0), ("b", 2, True, "none", "none", T0, "", 0.0), (None, 9, True, "none", "none", T0, "", 0.0), ("b", None, True, "none", "none", T0, "", 0.0),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["annotator"], k): LABELS[k][r[k]] for r in latest_votes(df).where("doc_id = 'a'").collect() for k in LABELS if r[k] is not None}
    assert got == {(1, "technology_present"): "false", (1, "technology_type"): "call_light", (1, "failure_role"): "absent", (2, "technology_type"): "call_light", (3, "technology_present"): "true", (3, "failure_role"): "absent"}
    c, _ = annotator_consensus(df)
    assert {(r["field_name"], r["label"], r["agreement"]) for r in c.collect()} == {("technology_present", c.where("field_name = 'technology_present'").first()["label"], 0.0), ("technology_type", "call_light", 1.0), ("failure_role", "absent", 1.0)}
    c, rel = annotator_consensus(df.limit(0))
    assert c.count() == 0 and rel.count() == 0


def test_tables_give_what_arrays_give(spark, data):
    from sievemark.session import table

    df = table(spark, data, "annotations")
    short = lambda out: sorted(tuple(round(x, 7) if isinstance(x, float) else str(x) for x in r) for r in out.collect())
    wanted = [short(x) for x in annotator_consensus(df, most_steps=4)]
    assert wanted[0] and wanted == [short(x) for x in annotator_consensus(df, most_steps=4, most_votes=2)]
    assert wanted == [short(x) for x in annotator_consensus(df.unionByName(df).repartition(5), most_steps=4, most_annotators=3)]
