"""Tables that grow with the craters meet by a shuffle, not through the driver, though files of this size pass for small."""

import pytest

from regolith.operators import matching, patterns
from regolith.plans import queries
from regolith.plans.queries import QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("keys"))
    for table, key, n in (("part", "p_partkey", 300), ("supplier", "s_suppkey", 15)):
        spark.createDataFrame([(k,) for k in range(n)], f"{key} bigint").coalesce(1).write.parquet(f"{d}/{table}.parquet")
    return d


def broadcasts(df) -> list[str]:
    return [x.strip() for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Broadcast" in x]


def test_neighbours_are_not_broadcast(spark, folder):
    assert broadcasts(QUERIES["knn_neighbours"](spark, folder)) == []


def test_nearest_targets_are_not_broadcast(spark, folder):
    assert broadcasts(QUERIES["nearest_join_sized"](spark, folder)) == []


def test_pairs_made_single_are_not_broadcast(spark, folder):
    assert broadcasts(QUERIES["one_to_one_pairs"](spark, folder)) == []


def test_points_in_circles_are_not_broadcast(spark, folder):
    assert broadcasts(QUERIES["point_in_circle"](spark, folder)) == []


def test_triangles_of_neighbours_are_not_broadcast(spark, folder):
    assert broadcasts(QUERIES["triangles_knn"](spark, folder)) == []


@pytest.fixture
def settled_plans(monkeypatch):
    """What is computed before the end."""
    plans = []
    for module in (matching, patterns, queries):
        monkeypatch.setattr(module, "settled", lambda df, f=module.settled: (plans.append(df), f(df))[1])
    return plans


@pytest.mark.parametrize("name", ["lookalike_join", "top_hypotheses", "hypothesis_votes", "hypothesis_winner", "zoom_uniqueness", "match_pair", "match_pair_refined", "pattern_ambiguity", "match_learner"])
def test_what_grows_with_triangles_is_not_broadcast(spark, folder, settled_plans, name):
    assert [b for df in (QUERIES[name](spark, folder), *settled_plans) for b in broadcasts(df)] == []
