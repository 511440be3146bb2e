"""Physical-plan checks: no registered query plans a cross product or a nested-loop join."""

import __spark_entry__ as E

# ML / streaming / sink queries run their jobs while being built; they are covered elsewhere.
EAGER = {"m7_forest", "m7_forest_cv", "m8_boost", "m9_effects", "m10_rlearner", "m10_orthogonal_forest", "m12_quantiles",
         "m16_model_compare", "m17_effect_extremes", "r1_ingest", "r2_dedup", "r3_activity", "s20_sinks",
         "s21_result_sinks", "s22_model_persist", "s1_s5_csv_scan", "v15_summary", "s19_resumable_ingest"}


def test_no_cross_joins_in_any_plan(spark, sf_dir):
    offenders = {}
    for key, fn in sorted(E.queries().items()):
        if key in EAGER:
            continue
        plan = fn(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        bad = [op for op in ("CartesianProduct", "BroadcastNestedLoopJoin") if op in plan]
        if bad:
            offenders[key] = bad
    assert offenders == {}


def test_feature_scan_prunes_columns(spark, sf_dir):
    from pricelens.plans.common import features
    plan = features(spark, sf_dir).select("project_id", "funding_ratio").where("funding_ratio > 1") \
        ._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(funding_ratio), GreaterThan(funding_ratio,1.0)]" in plan
    assert "ReadSchema: struct<project_id:bigint,funding_ratio:double>" in plan
