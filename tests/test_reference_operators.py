"""Golden values, closed forms and negative cases of the measurement operators."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievemark.contracts import AnalysisError, Config, ConfigError, CorpusError, ForecastError, ReleaseError, ReleasePolicy, Thresholds, prompt_hash, stage_seed
from sievemark.functions import diffusion
from sievemark.functions.hashing import stable_doc_id
from sievemark.functions.severity import decompose
from sievemark.functions.text import count_term, count_tokens, locate_span, requirement_text, strip_boilerplate
from sievemark.operators import agreement, corpus, forecast, judgements, release, reliability, stats, stratified, taxonomy, trends
from sievemark.plans import exhibits, gate, pipeline
from sievemark.session import table
from sievemark.sources import readers, writers

CANON = ["12332141 2...".replace(" ", ""), "12332241 25.3".replace(" ", ""), ".33323422 51.".replace(" ", ""), "12332441 251.".replace(" ", "")]


def canonical(spark):
    rows = [(f"u{u}", c, int(v)) for c, line in enumerate(CANON) for u, v in enumerate(line) if v != "."]
    return spark.createDataFrame(rows, "unit string, coder int, value int")


@pytest.mark.parametrize("metric, value", [("nominal", 0.7434), ("ordinal", 0.8154), ("interval", 0.8491), ("ratio", 0.7974)])
def test_alpha_published(spark, metric, value):
    t = reliability.alpha_terms(canonical(spark), metric).first()
    assert t["total"] == pytest.approx(40) and t["alpha"] == pytest.approx(value, abs=5e-4)
    pairs = reliability.pair_decomposition(canonical(spark), metric).collect()
    assert sum(p["n_pairs"] for p in pairs) == 55
    assert 1 - 2 * sum(p["n_pairs"] * p["weight"] * p["d"] for p in pairs) / t["expected"] == pytest.approx(t["alpha"])


def test_alpha_edges(spark):
    one = spark.createDataFrame([("a", 1, 1), ("a", 2, 1), ("b", 1, 1)], "unit string, coder int, value int")
    assert reliability.alpha_terms(one).first()["alpha"] == 1.0
    with pytest.raises(AnalysisError):
        reliability.alpha_bootstrap(one.limit(0))
    b = reliability.alpha_bootstrap(canonical(spark), "nominal", 500, 0.8, 1)
    assert b["lo"] < b["point"] < b["hi"] and 0 < b["q"] < 1


def test_ids_and_seeds(spark):
    d = spark.createDataFrame([("015009", "2024-01-15", " f689 ", 0)], "c string, d string, t string, o int")
    assert d.select(stable_doc_id(d.c, d.d, d.t, d.o)).first()[0] == "1e1961c44eaef688"
    assert [stage_seed(20260101, s) for s in ("study1", "validate", "rq1", "rq2", "rq3", "rq4")] == [3656076679, 4090680815, 2122407923, 1588086550, 194400639, 840047502]
    assert len(prompt_hash("x")) == 12


def test_severity(spark):
    d = spark.createDataFrame([(x,) for x in ["D", "G", "L", " g ", "Z", None, ""]], "s string")
    got = [tuple(r) for r in d.select(*[c.alias(k) for k, c in decompose(d.s).items()]).collect()]
    assert got == [(2, 1, False, False), (3, 1, True, False), (4, 3, True, True), (3, 1, True, False), (None, None, False, False), (None, None, False, False), (None, None, False, False)]


def test_text(spark):
    d = spark.createDataFrame([("Intro. Based on interview, : the call light. Call-light CALL LIGHT",), ("",), (None,)], "t string")
    assert [r[0] for r in d.select(count_tokens(d.t)).collect()] == [11, 0, None]
    assert d.select(strip_boilerplate(d.t)).first()[0] == "the call light. Call-light CALL LIGHT"
    assert d.select(count_term(d.t, "call light")).first()[0] == 2
    s = spark.createDataFrame([("ab\U0001f600cd", "cd"), ("abc", ""), ("abc", "z")], "t string, s string")
    a, b = locate_span(s.t, s.s)
    assert [tuple(r) for r in s.select(a, b).collect()] == [(3, 5), (None, None), (None, None)]
    q = spark.createDataFrame([("F1 must (Rev. 2, x) have\na call system INTENT hidden equipment",)], "b string")
    assert q.select(requirement_text(q.b)).first()[0] == "F1 must have a call system"


def test_response_parser(spark):
    ok = '{"technology_present": true, "technology_type": "call_light", "failure_role": "absent", "harm_linked": false, "evidence_span": "x", "confidence": 0.7}'
    cases = {
        "I cannot help with that": "refusal", "no idea": "no JSON object found", '{"technology_present": tru}': "invalid JSON", ok.replace(', "confidence": 0.7', ""): "missing keys: confidence",
        ok.replace("true", '"true"'): "technology_present not boolean", ok.replace("call_light", "toaster"): "unknown technology_type toaster", ok.replace("0.7", '"0.7"'): None, ok.replace("0.7", "1.2"): "confidence outside [0, 1]",
        ok.replace("true", "false"): "technology_present is false but a type or role was named", "well " + ok + " so": None, ok + ok: "invalid JSON", ok: None,
    }
    d = spark.createDataFrame([(k, "a x b") for k in cases], "response string, narrative string")
    got = {r["response"]: r for r in judgements.parse_responses(d, "response", "narrative").collect()}
    assert {k: r["parse_error"] for k, r in got.items()} == cases
    assert got[ok]["evidence_span_start"] == 2 and got[ok]["confidence"] == 0.7 and got["no idea"]["technology_present"] is None


def test_corpus_build(spark, tmp_path):
    text = "Intro based on observation: " + " ".join(["word"] * 45)
    (tmp_path / "a.csv").write_text('CCN,Survey Date,F Tag,Narrative,Scope Severity,Is Complaint,State\n015009,2024-01-15,F689,"' + text + '\nmore",,Y,\n15009,2024-01-15,F689,short,D,N,TX\n,2024-01-15,F689,x,D,N,TX\n')
    rec = readers.read_archives(spark, str(tmp_path / "a.csv"))
    assert [r["offset"] for r in rec.orderBy("offset").collect()] == [0, 1, 2]
    cit = spark.createDataFrame([("15009", "01/15/2024", "0689", "G", "Q", "Y"), ("15009", "01/15/2024", "0689", "J", "Q", "Y")], "cms_certification_number_ccn string, survey_date string, deficiency_tag_number string, scope_severity string, deficiency_category string, standard_deficiency string")
    prov = spark.createDataFrame([("15009", "For profit", "120", "IN"), ("15009", "For profit", "beds", "IN")], "cms_certification_number_ccn string, ownership_type string, number_of_certified_beds string, state string")
    c = corpus.build_corpus(rec, cit, prov)
    r = c.collect()
    assert len(r) == 1 and r[0]["doc_id"] == "1e1961c44eaef688" and r[0]["scope_severity"] == "G" and r[0]["actual_harm"] and r[0]["state"] == "IN" and r[0]["year"] == 2024 and r[0]["n_tokens"] == 46
    assert corpus.dropped_short(rec).first()["dropped_short"] == 1
    with pytest.raises(CorpusError):
        corpus.assert_unique(c.unionByName(c))
    with pytest.raises(CorpusError):
        readers.read_archives(spark, "x", "xml")


def test_other_archives(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"ccn": "1", "narrative": "x"}\n\n{"ccn": "2"}\n')
    assert [(r["ccn"], r["offset"]) for r in readers.read_archives(spark, str(tmp_path / "a.jsonl"), "jsonl").orderBy("offset").collect()] == [("1", 0), ("2", 2)]
    (tmp_path / "r.txt").write_text("CCN: 015009\nDATE: 2024-01-15\nintro\nF 689 first\nmore\nK0100 second")
    got = readers.read_archives(spark, str(tmp_path / "r.txt"), "text").orderBy("offset").collect()
    assert [(r["f_tag"], r["narrative"]) for r in got] == [("F689", "first\nmore"), ("K0100", "second")]
    (tmp_path / "bad.txt").write_text("nothing")
    with pytest.raises(Exception, match="no report header"):
        readers.read_archives(spark, str(tmp_path / "bad.txt"), "text").collect()
    assert len(readers.taxonomy_rows(None)) == 7 and readers.taxonomy_rows({"_meta": 1, "F1": True, "F2": "none"})[0][1] == "full"
    with pytest.raises(AnalysisError):
        readers.taxonomy_rows({"F1": "half"})
    m = spark.createDataFrame([("a.jsonl", "0")], "file_name string, sha256 string")
    assert readers.changed_files(spark, str(tmp_path / "*.jsonl"), m).count() == 1


def test_taxonomy(spark):
    book = ["pre", "F001", "a call  system", "INTENT", "sensor", "F002", "sensors and a sensor, alarm", "F001", "tail", "F919", "nothing", "F003", "plain"]
    lines = spark.createDataFrame(list(enumerate(book)), "line_no int, line string")
    got = {r["f_tag"]: r for r in taxonomy.classify_blocks(taxonomy.tag_blocks(lines)).collect()}
    assert {k: (v["level"], v["method"]) for k, v in got.items()} == {"F001": ("full", "rule"), "F002": ("partial", "rule"), "F919": ("full", "curated"), "F003": ("none", "rule")}
    assert got["F002"]["justification"] == "sensor (2), alarm (1)"
    with pytest.raises(AnalysisError):
        taxonomy.build_taxonomy(lines)
    assert {r["level"]: r["n_tags"] for r in taxonomy.level_counts(spark.createDataFrame([("full",)], "level string")).collect()} == {"full": 1, "partial": 0, "none": 0}


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from([-1.0, 1.0, 2.0, 3.0, 4.0]), st.integers(1, 500), min_size=1), st.integers(1, 300))
def test_quotas(sizes, n):
    q = stratified.level_quotas(sizes, n, {4.0: 10})
    assert sum(q.values()) == min(n, sum(sizes.values())) and all(0 <= q[k] <= sizes[k] for k in q)
    assert q.get(4.0, 10) >= min(10, n, sizes.get(4.0, 10))


def test_stratified(spark, data):
    c = table(spark, data, "corpus")
    s = stratified.stratified_sample(c, 60, 3, {3.0: 10})
    rows = s.collect()
    ids = [r["doc_id"] for r in rows]
    assert len(ids) == 60 == len(set(ids)) and ids == sorted(ids)
    assert sum(r["severity_level"] == 3 for r in rows) >= 10
    assert ids == [r["doc_id"] for r in stratified.stratified_sample(c.unionByName(c).repartition(7), 60, 3, {3.0: 10}).collect()]
    assert sum(r["sampling_weight"] for r in rows) == pytest.approx(c.count())
    assert stratified.stratified_sample(c.limit(0), 5, 1).count() == 0 and stratified.stratified_sample(c, 10**6, 1).count() == c.count()


def test_stratified_takes_exact_quotas(spark):
    # 20 years a level: single rows go to the years by remainder, and no level loses its floor
    c = spark.range(2200).selectExpr("concat('d', id) as doc_id", "if(id < 40, 4.0D, 2.0D) as severity_level", "id % 20 as year")
    for seed in range(3):
        rows = stratified.stratified_sample(c, 30, seed, {4.0: 10}).collect()
        assert [sum(r["severity_level"] == k for r in rows) for k in (4, 2)] == [10, 20]
        assert {r["year"] for r in rows if r["severity_level"] == 2} == set(range(20))


def test_smallest_keys(spark):
    rows = spark.range(5000).selectExpr("concat('k', id) as k", "if(id < 4000, 'hot', 'cold') as c")
    quotas = spark.createDataFrame([(1, "hot", 700, 4000), (1, "cold", 20, 1000), (2, "cold", 2000, 1000)], "p int, c string, quota int, cell_rows bigint")
    keys = {}
    for slack in (8.0, 0.01):  # with hardly any slack the thresholds fail and cells are ranked in full
        got = stratified.smallest_keys(rows, quotas, ["c"], "k", 5, ("p",), slack).collect()
        keys[slack] = {(r["p"], r["k"]) for r in got}
        assert len(got) == 1720 and {(p, c): n for p, c, n in spark.createDataFrame(got).groupBy("p", "c").count().collect()} == {(1, "hot"): 700, (1, "cold"): 20, (2, "cold"): 1000}
    assert keys[8.0] == keys[0.01]
    want = rows.where("c = 'hot'").select("k", stratified.random_key(5, F.lit(1), F.col("k")).alias("u")).orderBy("u").limit(700).collect()
    assert {r["k"] for r in want} == {k for p, k in keys[8.0] if p == 1} & {r["k"] for r in rows.where("c = 'hot'").collect()}


def test_agreement(spark):
    rows = [(True, True)] * 4 + [(True, False)] * 2 + [(False, True)] + [(False, False)] * 3 + [(None, False)]
    d = spark.createDataFrame(rows, "g boolean, p boolean")
    s = agreement.binary_scores(agreement.binary_cells(d, F.col("g"), F.col("p"))).first()
    assert (s["tp"], s["fp"], s["fn"], s["tn"]) == (4, 1, 2, 4) and s["f1"] == pytest.approx(8 / 11)
    none = agreement.binary_scores(agreement.binary_cells(spark.createDataFrame([(False, False)], "g boolean, p boolean"), F.col("g"), F.col("p"))).first()
    assert (none["precision"], none["recall"], none["f1"], none["kappa"]) == (0, 0, 0, None)
    assert agreement.kappa_of({"tp": 0, "fp": 0, "fn": 0, "tn": 3}) is None
    x = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 5.0), (None, 1.0)], "x double, y double")
    assert agreement.spearman(x, "x", "y").first()["rho"] == pytest.approx(0.8660254)
    assert agreement.spearman(x.withColumn("y", F.lit(1.0)), "x", "y").first()["rho"] is None
    b = agreement.bootstrap_cells({"tp": 40, "fp": 5, "fn": 5, "tn": 50}, agreement.f1_of, 300, 1)
    assert b["lo"] < b["point"] < b["hi"]


def test_estimators(spark):
    r = np.random.default_rng(1)
    g = r.integers(0, 12, 400)
    x1, x2 = r.normal(size=400), r.normal(size=400)
    y = 2 * x1 - x2 + g + r.normal(size=400) * 0.1
    d = spark.createDataFrame([(int(a), float(b), float(c), float(e)) for a, b, c, e in zip(g, x1, x2, y)], "g int, x1 double, x2 double, y double")
    m = stats.within_system(stats.group_moments(d, "y", ["x1", "x2"], ["g"]), 2).first().asDict()
    one = np.eye(12)[g]
    want = np.linalg.lstsq(np.column_stack([x1, x2, one]), y, rcond=None)[0][:2]
    assert stats.solve_within(m, 2) == pytest.approx(want.tolist())
    flat = d.withColumn("x2", F.col("g").cast("double"))
    assert stats.solve_within(stats.within_system(stats.group_moments(flat, "y", ["x1", "x2"], ["g"]), 2).first().asDict(), 2)[1] is None
    assert stats.two_way_slope(d.withColumn("h", F.col("g") % 3), "y", "x1", "g", "h") == pytest.approx(stats.fe_slope(d, "y", "x1", "g").first()["beta"], abs=1e-6)
    assert stats.rogan_gladen(0.3, 0.9, 0.8) == pytest.approx(0.1 / 0.7)
    with pytest.raises(AnalysisError):
        stats.rogan_gladen(0.3, 0.5, 0.52)
    two = spark.range(200).selectExpr("id as h", "cast(if(id < 100, id < 20, id < 160) as int) as y", "cast(id >= 100 as double) as x0")
    fits, good = stats.logistic_fits(two, 1, 40, 3)
    beta = fits[0]
    again, _ = stats.logistic_fits(two.repartition(7), 1, 40, 3)
    assert good.all() and np.allclose(fits, again) and 0.15 < fits[1:, 1].std() < 0.6
    frame = d.selectExpr("cast(g as string) as ccn", "x1", "x2", "y", "true as technology_present")
    boots = [[tuple(r) for r in stats.equity_model(f, ["x1", "x2"], F.col("y") > 5, n_boot=60, seed=4).collect()] for f in (frame, frame.repartition(6))]
    assert boots[0][0][2] == pytest.approx(boots[1][0][2]) and boots[0][1][3] == pytest.approx(boots[1][1][3])
    assert beta[0] == pytest.approx(math.log(0.25), abs=1e-4) and beta[1] == pytest.approx(math.log(1.5) - math.log(0.25), abs=1e-4)


def test_equity(spark, data):
    from sievemark.plans.reference_queries import frame

    f = frame(spark, data)
    with pytest.raises(AnalysisError):
        stats.equity_model(f, ["n_tokens"], F.col("illegible"), gate={"passed": False})
    r = stats.equity_model(f, ["n_tokens"], F.col("illegible"), n_boot=60, seed=1).first()
    assert r["status"] == "estimated" and r["n"] > 0


def test_curves_and_anchor():
    assert diffusion.np_logistic(7.0, 100, 0.3, 7) == pytest.approx(50)
    assert diffusion.np_bass(3.0, 0.2, 0.0, 10) == pytest.approx(10 * (1 - math.exp(-0.6)))
    for m, v in (("logistic", np.array([100, 0.3, 7.0])), ("bass", np.array([0.01, 0.4, 100.0]))):
        assert diffusion.CURVES[m][0](forecast.anchor(m, v, 63.0), *v) == pytest.approx(63)


def test_fit_recovers_and_guards(spark):
    t = np.arange(24.0)
    y = diffusion.period_counts("logistic", t, np.array([1000, 0.4, 10.0]))
    f = forecast.fit_series("logistic", t, y)
    assert f.converged and f.params["m"] == pytest.approx(1000, rel=1e-3) and f.params["t0"] == pytest.approx(10, rel=1e-3)
    yb = diffusion.period_counts("bass", t, np.array([0.02, 0.4, 1000.0]))
    assert forecast.fit_series("bass", t, yb).params["q"] == pytest.approx(0.4, rel=1e-2)
    series = spark.createDataFrame(list(zip(t.tolist(), y.tolist())), "t double, y double")
    passed = forecast.backtest(series, 16)
    assert passed["passed"] and passed["converged"] and passed["n_test"] == 8
    assert {r["method"] for r in forecast.error_measures(forecast.held_out(series, 16)).collect()} == {"logistic", "carried_on"}
    assert [x["cutoff"] for x in forecast.rolling_backtest(series, 21)] == [21, 22, 23]
    for bad in ((t[:4], y[:4]), (t, -y), (t[::-1], y)):
        with pytest.raises(ForecastError):
            forecast.fit_series("logistic", *bad)
    with pytest.raises(ForecastError):
        forecast.Scenario("x", p_mult=0)
    p = forecast.project(spark, f, t, y, [forecast.SCENARIOS["status_quo"], forecast.Scenario("low", m_mult=0.5)], 5, 10)
    assert {r["scenario"]: r["status"] for r in p.collect()}["low"] == "ceiling_below_observed"


def test_release(spark, tmp_path):
    agg = spark.createDataFrame([("a", 9), ("b", 10), ("c", None)], "k string, n int")
    got = {r["k"]: (r["n"], r["suppressed"]) for r in release.suppress_small_cells(agg).collect()}
    assert got == {"a": (None, True), "b": (10, False), "c": (None, True)}
    bad = spark.createDataFrame([("d1", "a story of three words")], "doc_id string, narrative string")
    assert ("narrative", "forbidden") in {(r["field_name"], r["problem"]) for r in release.validate_schema(bad).collect()}
    assert ("*", "empty") in {(r["field_name"], r["problem"]) for r in release.validate_schema(bad.limit(0)).collect()}
    with pytest.raises(ReleaseError):
        release.write_release(bad, agg, str(tmp_path / "x"))
    good = release.prepare_annotations(spark.createDataFrame([("d1", "015009")], "doc_id string, ccn string"), ReleasePolicy(hash_ccn=True, salt="s"))
    assert good.first()["ccn"] != "015009"
    review = release.write_release(good, release.suppress_small_cells(agg), str(tmp_path / "y"))
    assert review["cleared"] and "codebook.json" in writers.load_json(tmp_path / "y" / "MANIFEST.json")


def test_gate_and_config():
    full = {"human_alpha_bootstrap": {"q": 0.01}, "model_vs_human": {"f1": {"point": 0.9}, "kappa": {"point": 0.7}}, "prompt_sensitivity": {"prevalence_spread": 0.01}, "model_sensitivity": {"facility_rho": 0.8}, "differential_error": {"flagged": []}, "per_category_alpha": {"min_alpha": 0.5}}
    g = gate.evaluate_gate(full)
    assert g["passed"] and not g["per_role_claims_permitted"]
    assert not gate.evaluate_gate({**full, "model_vs_human": None})["passed"]
    assert not gate.evaluate_gate({**full, "differential_error": {"flagged": ["x"]}})["equity_permitted"]
    with pytest.raises(ConfigError):
        Config.from_mapping({"nope": 1})
    assert Config().fingerprint() == Config().fingerprint() and len(Config().fingerprint()) == 12
    assert Thresholds.from_mapping({"f1_min": 0.5, "x": 1}).f1_min == 0.5


def test_pipeline(spark, data, tmp_path):
    from sievemark.plans.reference_queries import levels

    tables = {t: table(spark, data, t) for t in ("corpus", "extracted", "annotations")} | {"taxonomy": levels(spark, data)}
    cfg = Config.from_mapping({"corpus": {"validation_sample_n": 50}, "validation": {"n_bootstrap": 50, "alpha_bootstrap": 200}})
    uncovered = pipeline.run_pipeline(spark, cfg, tables, ["validate"])
    assert uncovered["stages"]["validate"]["status"] == "failed" and "labels cover" in uncovered["stages"]["validate"]["reason"]
    tables["corpus"] = tables["corpus"].join(tables["annotations"].select("doc_id").distinct(), "doc_id", "left_semi")
    variants = tables["corpus"].select("doc_id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("variant"), F.lit(True).alias("technology_present"))
    r = pipeline.run_pipeline(spark, cfg, tables, ["study1", "validate", "rq1"], str(tmp_path / "r.json"))
    assert r["stages"]["study1"]["status"] == "ok" and r["stages"]["validate"]["status"] == "ok", r["stages"]
    v = r["stages"]["validate"]["result"]
    assert set(v["checks_not_evaluated"]) >= {"prompt_sensitivity", "model_sensitivity", "self_consistency"} and v["n_sample"] == min(50, tables["corpus"].count()) and v["gold_overlap"] == 1.0
    assert 0 <= v["error_rates"]["sensitivity"] <= 1 and v["failure_role_agreement"]["n"] > 0 and set(v["human_alpha_bootstrap"]["q_ladder"]) == {"0.9", "0.8", "0.7", "0.667"}
    full = pipeline.run_pipeline(spark, cfg, tables | {"predictions": variants, "second_model": variants, "second_pass": tables["extracted"].where("parse_ok")}, ["validate"])["stages"]["validate"]["result"]
    assert full["prompt_sensitivity"]["prevalence_spread"] == 0 and full["self_consistency"]["n"] > 0 and "prompt_sensitivity" not in full["checks_not_evaluated"]
    assert r["stages"]["rq1"]["status"] == ("ok" if r["gate"]["passed"] else "withheld")
    done = pipeline.run_pipeline(spark, cfg, tables, ["rq1", "rq2", "rq3", "rq4"], previous={"gate": {"passed": True, "equity_permitted": True, "checks": {}}})
    assert [done["stages"][s]["status"] for s in ("rq1", "rq2", "rq3")] == ["ok"] * 3, {k: v.get("reason") for k, v in done["stages"].items()}
    assert done["stages"]["rq4"]["result"]["projection"]["status"] in ("ok", "not_identifiable")
    assert set(exhibits.render_all(spark, done, str(tmp_path / "ex")).values()) == {"written"}
    assert set(done["summary"]["exhibits"]["available"]) >= {"figure1_overall", "table3_gap", "table4_equity"} and "table2_validation" in done["summary"]["exhibits"]["unavailable"]
    made = pipeline.run_pipeline(spark, Config.from_mapping({"extraction": {"prompt": "NARRATIVE: {{NARRATIVE}} INSTRUCTIONS: camera", "pilot": 30}}), {"corpus": tables["corpus"]}, ["corpus", "extract"])
    assert made["stages"]["extract"]["result"]["n"] == min(30, tables["corpus"].count()) == made["stages"]["extract"]["result"]["n_parsed"], made["stages"]
    assert pipeline.exit_code(done) == 0 and pipeline.exit_code(r) in (0, 2)


def test_exhibit_census(spark, data):
    from sievemark.plans.reference_queries import _counts

    t = exhibits.vocabulary_census(_counts(spark, data)).collect()
    assert len(t) == 9 + 3


def test_stream(spark, data, tmp_path):
    from sievemark.streaming.prevalence import start_windowed_share, windowed_share

    e = table(spark, data, "events")
    e.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = start_windowed_share(stream, F.col("event_type") == "purchase", str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = {r["window_start"]: r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r["window_start"]: r["n"] for r in windowed_share(e, F.col("event_type") == "purchase").collect()}
    assert got and all(want[k] == v for k, v in got.items())


def test_plans_stay_in_the_jvm(spark, data):
    from sievemark.plans.reference_queries import frame

    plan = trends.gap_breakdown(frame(spark, data))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "narrative" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_communities_prompts_and_meta(spark):
    from sievemark.functions.text import build_prompt

    f = spark.createDataFrame([("a", 1010, "x"), ("b", 99999, "x"), ("c", None, "x")], "ccn string, county_ssa int, state string")
    cross = spark.createDataFrame([("01010", "1001"), ("01010", "1001"), (None, "1003")], "county_ssa string, county_fips string")
    acs = spark.createDataFrame([(1001, 40.5), (1001, 41.0), (1003, 1.0)], "county_fips int, minority double")
    assert {r["ccn"]: r["minority"] for r in corpus.link_communities(f, cross, acs).collect()} == {"a": 40.5, "b": None, "c": None}
    d = spark.createDataFrame([("n",)], "x string")
    assert d.select(build_prompt("A {{NARRATIVE}} B {{NARRATIVE}}.", F.col("x"))).first()[0] == "A n B n."
    with pytest.raises(ValueError):
        build_prompt("no slot", F.col("x"))
    lines = spark.createDataFrame([(0, "x"), (1, "F001"), (2, "(Rev. 225; Issued) alarm"), (3, "(Rev. 9)")], "line_no int, line string")
    t = taxonomy.classify_blocks(taxonomy.tag_blocks(lines))
    m = taxonomy.taxonomy_meta(lines, t, "book").first()
    assert (m["source"], m["revision"], m["n_tags"], m["n_partial"]) == ("book", "(Rev. 225; Issued)", 1, 1)
    c = spark.createDataFrame([(1, "x", 1), (1, "y", 0)], "unit int, coder string, value int")
    assert reliability.coder_matrix(c).first().asDict() == {"unit": 1, "x": 1, "y": 0}
    bad = spark.createDataFrame([("d", "maybe", "12")], "doc_id string, is_complaint string, certified_beds string")
    assert {r["column"]: r["n_failed"] for r in corpus.cast_failures(bad).collect()} == {"doc_id": 0, "is_complaint": 1, "certified_beds": 0}
    body = judgements.BACKENDS["keyword"]()(["NARRATIVE: a bed alarm was disabled INSTRUCTIONS: camera", "NARRATIVE: nothing INSTRUCTIONS: alarm"])
    assert '"fall_alarm_or_sensor"' in body[0] and '"workaround"' in body[0] and '"technology_present": false' in body[1]


def test_command_line(spark, data, tmp_path, capsys):
    from sievemark.__main__ import main

    code = main(["--tables", data, "--stages", "corpus,extract,rq2", "--out", str(tmp_path / "r.json")])
    assert code == 2 and "rq2" in writers.load_json(tmp_path / "r.json")["stages"] and "withheld" in capsys.readouterr().out
