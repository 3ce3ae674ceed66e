"""Stages read a response once, however many of its fields they take."""

from tessera.operators import stages


def test_each_stage_parses_once(spark):
    q = spark.range(3).selectExpr("id AS query_id")
    out = spark.createDataFrame([(0, "validation", 0, '{"is_valid": true}')], "query_id long, stage string, attempt int, response string")
    state = stages.attach_outputs(q, out).selectExpr("*", "1 AS n_retrieved", "true AS is_sufficient")
    for made in (stages.validation(state, None), stages.intent(state, None), stages.enhancement(state), stages.enhancement(state, None, 1),
                 stages.strategy(state, None), stages.context_verdict(state, None, 0), stages.response(state, None)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json(") == 1 and plan.count("RLIKE") == 1, plan


def test_fields_of_one_response(spark):
    rows = [(0, '{"is_valid": true, "reason": "a"}'), (1, "[1]"), (2, '{"reason": "b"}'), (3, "oops"), (4, None), (5, '{"is_valid": false} x')]
    out = spark.createDataFrame([(i, "validation", 0, r) for i, r in rows], "query_id long, stage string, attempt int, response string")
    got = stages.validation(spark.range(6).selectExpr("id AS query_id"), out).orderBy("query_id").collect()
    bad = (False, stages.MSG_VALIDATION_PARSE)
    assert [(r.valid, r.reason) for r in got] == [(True, "a"), bad, (False, "Validation error: 'is_valid'"), bad, bad, bad]
