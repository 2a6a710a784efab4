"""The rows of a task don't grow with the table where gold and found fields meet."""

from seriesmill.plans import evaluation_plans


def test_tasks_grow_with_rows(spark, monkeypatch):
    run = evaluation_plans.QUERIES["e15_field_metrics"]
    want = run(spark, "/root/testdata/sf0.001").collect()
    monkeypatch.setattr(evaluation_plans, "_ROWS", 500)
    df = run(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    # about 6,000 rows in 12 or more tasks; one more shuffle, by document, of what the join leaves
    assert "hashpartitioning(doc" in plan and "REPARTITION_BY_NUM" in plan and ", 4)" in plan
    tasks = {int(x.split(")")[0]) for x in plan.split("hashpartitioning(")[1:] for x in [x.split(", ", 2)[-1]] if x.split(")")[0].isdigit()}
    assert max(tasks) >= 12
    assert df.collect() == want
