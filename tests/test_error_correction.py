"""Prevalence corrected with gold labels that tell little or nothing about the instrument."""

import datetime

import pandas as pd
import pytest

from sievemark.plans import reference_queries
from tests.oracle import connect, same


def tables(folder, tp, fp, fn, tn, extra_true=0, extra_false=0):
    """Narratives with these cells, and some without a gold label."""
    rows = [(True, True)] * tp + [(False, True)] * fp + [(True, False)] * fn + [(False, False)] * tn + [(None, True)] * extra_true + [(None, False)] * extra_false
    d = pd.DataFrame({"doc_id": [f"d{i}" for i in range(len(rows))], "gold": [g for g, _ in rows], "pred": [p for _, p in rows]}, dtype=object)
    gold = d[d["gold"].notna()]
    day = pd.Series([datetime.datetime(2024, 1, 1)] * len(gold), index=gold.index, dtype="datetime64[us]")
    texts = lambda x: pd.Series(["staff"] * len(x), index=x.index, dtype="string")
    gold = pd.DataFrame({"doc_id": gold["doc_id"].astype("string"), "annotator": pd.Series(1, index=gold.index, dtype="int32"), "technology_present": gold["gold"].astype("boolean"), "failure_role": texts(gold), "labelled_at": day})
    gold.to_parquet(f"{folder}/annotations.parquet", index=False)
    pd.DataFrame({"doc_id": d["doc_id"].astype("string"), "parse_ok": pd.Series(True, index=d.index, dtype="boolean"), "technology_present": d["pred"].astype("boolean"), "failure_role": texts(d)}).to_parquet(f"{folder}/extracted.parquet", index=False)
    return str(folder)


@pytest.mark.parametrize("cells, reason", [((33, 31, 67, 69), "sensitivity and specificity are too near chance"), ((0, 4, 0, 6), "the gold labels lack one of the two classes"), ((0, 0, 0, 0), "the gold labels lack one of the two classes")])
def test_refused_correction_is_a_row_with_its_reason(spark, tmp_path, cells, reason):
    assert [tuple(r) for r in reference_queries.QUERIES["corrected_prevalence"](spark, tables(tmp_path, *cells)).collect()] == [(None, None, None, None, reason)]


def test_correction_has_no_reason_where_it_is_made(spark, tmp_path):
    r = reference_queries.QUERIES["corrected_prevalence"](spark, tables(tmp_path, 80, 10, 20, 90)).first()
    assert r["point"] == pytest.approx(0.5) and r["lo"] < r["point"] < r["hi"] and r["skipped"] == 0 and r["correction_unavailable"] is None


@pytest.mark.parametrize(
    "cells, want",
    [((33, 31, 67, 69), 0.5), ((80, 10, 20, 90), 0.5), ((5, 5, 5, 5), 1.0), ((5, 5, 5, 5, 0, 2), 0.0), ((5, 5, 5, 5, 2, 0), 1.0), ((49, 51, 51, 49, 9, 0), 0.0), ((0, 4, 0, 6), 1.0), ((3, 0, 4, 0), 1.0), ((0, 0, 0, 0, 2, 3), 1.0), ((0, 0, 0, 0), 1.0)],
)
def test_point_is_the_sqls_at_and_near_chance(spark, tmp_path, cells, want):
    folder = tables(tmp_path, *cells)
    df = reference_queries.QUERIES["rogan_gladen_point"](spark, folder)
    same(df, connect(folder), reference_queries.SQL["rogan_gladen_point"])
    assert df.first()["corrected"] == pytest.approx(want)
