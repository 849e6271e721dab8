"""Components by alternating stars against union-find."""

import random

import pytest

from outagelens.llm.components import components


def plain(links):
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {x: find(x) for x in top if find(x) != x}


def shapes():
    rng = random.Random(1)
    yield [(i, i + 1) for i in range(200)]  # a chain
    yield [(0, i) for i in range(1, 300)]  # a star
    yield [(300, i) for i in range(300)]  # its centre is the largest
    yield [(rng.randrange(500), rng.randrange(500)) for _ in range(400)]
    yield [(rng.randrange(60) - 30, rng.randrange(60) - 30) for _ in range(300)] * 2  # repeated, negative, loops
    yield [(rng.randrange(10 ** 15), i) for i in range(50)] + [(7, 7)]
    yield [(5, 9), (9, 2), (7, 9)]
    yield []


@pytest.mark.parametrize("links", list(shapes()), ids=range(8))
def test_classes_are_the_smallest_connected_nodes(spark, links):
    df = spark.createDataFrame(links, "a long, b long").repartition(4)
    got = components(df).collect()
    assert len(got) == len({r["node"] for r in got}) and {r["node"]: r["class"] for r in got} == plain(links)


def test_runs_over_batch_edges(spark):
    links = [(0, i) for i in range(1, 100)] + [(i, i + 1000) for i in range(1, 100)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = components(spark.createDataFrame(links, "a long, b long")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r["node"]: r["class"] for r in got} == plain(links)


def test_temporary_tables_go_and_kept_ones_stay(spark):
    import os

    from outagelens.llm.common import stored, temporary

    with temporary(spark):
        inner = stored(spark.range(5), "inner")
        kept = stored(inner, "kept", keep=True)
    path = lambda df: df.inputFiles()[0].removeprefix("file:")
    assert kept.count() == 5 and os.path.exists(path(kept))
    assert not os.path.exists(os.path.dirname(path(kept)).replace("-kept-", "-inner-"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FILE_NOT_EXIST|does not exist"):
        inner.collect()


def test_a_round_makes_its_edges_once(spark, monkeypatch):
    from outagelens.llm import components as C

    plans = []
    real = C._starred

    def seen(edges, star):
        plans.append(edges._jdf.queryExecution().optimizedPlan().toString())
        return real(edges, star)

    monkeypatch.setattr(C, "_starred", seen)
    links = [(i, i + 1) for i in range(40)]
    got = C.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"]: r["class"] for r in got} == plain(links)
    assert len(plans) > 2 and all(p.count("MapInArrow") <= 1 for p in plans)
