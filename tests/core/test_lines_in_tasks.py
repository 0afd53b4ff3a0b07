from cartoflux.plans import tables
from cartoflux.plans.network_queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_tasks_grow_in_number_with_the_lines(spark, monkeypatch):
    """What a task joins and pairs is bounded by a number of lines, and the edges are the same."""
    want = sorted(map(tuple, QUERIES["bipartite_edges"](spark, SF).collect()))
    monkeypatch.setattr(tables, "LINES", 500)
    lines = tables.read(spark, SF, "lineitem").count()
    assert tables.author_terms(spark, SF).rdd.getNumPartitions() == -(-lines // 500) > tables.FEW
    assert sorted(map(tuple, QUERIES["bipartite_edges"](spark, SF).collect())) == want
