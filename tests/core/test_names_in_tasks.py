import pytest

from cartoflux.plans import tables
from cartoflux.plans.network_queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("limit", ["-1", "10m"])
def test_tasks_that_join_names_grow_in_number_too(spark, monkeypatch, limit):
    """Whether Spark would send the names to all executors or not, no task joins many more than LINES lines."""
    queries = ("bipartite_incidence", "bipartite_kept_edges", "bipartite_kept_nodes", "norm_bipartite_col")
    want = {q: sorted(map(tuple, QUERIES[q](spark, SF).collect())) for q in queries}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        for lines, parts, plan in ((150, 200, "hashpartitioning(l_partkey"), (500, 200, "BroadcastHashJoin [l_partkey")):
            monkeypatch.setattr(tables, "LINES", lines)
            assert tables.read(spark, SF, "part").count() == parts
            tasks = -(-tables.read(spark, SF, "lineitem").count() // lines)
            found = tables.brand_terms(spark, SF)
            planned = found._jdf.queryExecution().executedPlan().toString()
            at = next(x for x in planned.splitlines() if plan in x)
            assert plan.startswith("Broadcast") or f", {tasks})" in at or f", {tasks}), REPARTITION_BY_NUM" in at
            assert {q: sorted(map(tuple, QUERIES[q](spark, SF).collect())) for q in queries} == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
