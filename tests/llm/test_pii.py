"""Accuracy on sentences of another hand, exact decoding, and the replaced text."""

import numpy as np
import pyarrow as pa
import pytest

from sievemark.llm.pii import K, LABELS, WEIGHTS, _END, _viterbi, cut_tokens, decode, default_field, distinct_tokens, find_personal_information, find_spans, fingerprint, redact
from sievemark.llm.pii_labels import KINDS, labelled_sentences
from tests.llm.pii_sentences import marked


@pytest.fixture(scope="module")
def field():
    return default_field()


def test_weights_belong_to_the_table():
    with np.load(WEIGHTS) as f:
        assert str(f["fingerprint"]) == fingerprint()


def test_sentences_of_another_hand(field):
    """Recall and precision of each kind on sentences that share no frame, name, host or street with the labelled table."""
    lines = marked()
    row, kind, a, z, _, off = find_spans(field, pa.array([t + _END for t, _ in lines]))
    got = [(int(r), LABELS[k], int(x - off[r]), int(y - off[r])) for r, k, x, y in zip(row, kind, a, z)]
    want = [(i, k, len(t[:x].encode()), len(t[:y].encode())) for i, (t, m) in enumerate(lines) for k, x, y in m]
    meets = lambda p, q: p[:2] == q[:2] and p[2] < q[3] and q[2] < p[3]
    for k in KINDS:
        w, g = [x for x in want if x[1] == k], [x for x in got if x[1] == k]
        recall, precision = sum(any(meets(x, y) for y in g) for x in w) / len(w), sum(any(meets(x, y) for y in w) for x in g) / len(g)
        assert recall >= 0.9 and precision >= 0.9, (k, recall, precision)


def test_pruned_decoding_is_exact(field):
    text = "\n".join(t for t, _ in labelled_sentences(60, 99)) + _END
    data = np.frombuffer(text.encode(), np.uint8)
    ids, names = distinct_tokens(data, *cut_tokens(data))
    at, y = decode(field, ids, names, np.array([len(ids) - 1]))
    table = field.tables(names)
    e = np.zeros((1, len(ids), K), np.float32)
    for o in range(7):
        j = np.arange(len(ids)) - (o - 3)
        ok = (j >= 0) & (j < len(ids))
        e[0, ok] += table[o][ids[j[ok]]]
    e[0, -1, 1:] = -1e6
    best = _viterbi(e, (field.step - field.step[0, 0]).astype(np.float32))[0]
    assert np.array_equal(np.flatnonzero(best), at) and np.array_equal(best[at], y)


def test_replaced(spark):
    rows = [
        (1, "Staff spoke with Priya Velmora about the fall. Room 12 was cold. Reply to priya.v@lakemail.org by Friday."), (2, None), (3, ""), (4, "Resident 12 and Staff B were seen near the Maple Hollow Care Center, serial 4552-39-8106."),
        (5, "They dialed (613) 555-0195 twice. " + "The tray was cold. " * 20000 + "The screen showed SSN 481-22-7730 in full."), (6, "Discharged to 48 Larkmoor Street, Pellam. "), (1, "The tray was cold."), (7, " \n "),
        (8, "A\u00a0nurse told\u2009Olumide\u00a0Farrant \u3000 to wait\u202f…\r\n\tok"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, narrative string, kind string")
    kinds = {(r["doc_id"], r["kind"]) for r in find_personal_information(df).collect()}
    assert kinds == {(1, "person_name"), (1, "email"), (5, "phone"), (5, "id_number"), (6, "street_address"), (8, "person_name")}
    out = {}
    for r in redact(df).collect():
        out.setdefault(r["doc_id"], []).append((r["narrative"], r["n_spans"]))
    assert ("Staff spoke with [PERSON_NAME] about the fall. Room 12 was cold. Reply to [EMAIL] by Friday.", 2) in out[1] and ("The tray was cold.", 0) in out[1]
    assert out[2] == [(None, 0)] and out[3] == [("", 0)] and out[4] == [(rows[3][1], 0)] and out[6][0][0] == "Discharged to [STREET_ADDRESS]. " and out[7] == [(" \n ", 0)]
    assert out[5][0][0].startswith("They dialed [PHONE] twice.") and out[5][0][0].endswith(" [ID_NUMBER] in full.")
    assert out[8] == [("A\u00a0nurse told\u2009[PERSON_NAME] \u3000 to wait\u202f…\r\n\tok", 1)]  # blanks outside spans stay as they are
    assert find_personal_information(df.limit(0)).count() == 0 and redact(df.limit(0)).count() == 0
    assert find_personal_information(df, batch_bytes=1).count() == 6


def test_one_scan(spark, data):
    plan = redact(spark.read.parquet(f"{data}/corpus.parquet"))._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("FileScan") == 1 and "Exchange" not in plan
