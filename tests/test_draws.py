from sievemark.plans import reference_queries


def test_error_audit_has_the_references_draws(spark, data):
    rows = reference_queries.error_audit(spark, data).collect()
    assert rows and max(r["n_draws"] for r in rows) > 900
