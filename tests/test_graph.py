import random

import pytest

from orrery.operators import graph


def reach(edges):
    nodes = {x for e in edges for x in e}
    out = {v: {b for a, b in edges if a == v} for v in nodes}
    far = {}
    for s in nodes:
        seen, front, d = {s: 0}, [s], 0
        while front:
            d += 1
            front = [w for w in {w for v in front for w in out[v]} if w not in seen]
            seen.update(dict.fromkeys(front, d))
        far[s] = seen
    return nodes, far


def frame(spark, edges, kind="long"):
    return spark.createDataFrame([(a, b) if kind == "long" else (f"n{a}", f"n{b}") for a, b in edges], f"src {kind}, dst {kind}")


@pytest.mark.parametrize("task_edges", [0, 5, graph.TASK_EDGES])
def test_components_and_parts_against_a_plain_search(spark, task_edges):
    rng = random.Random(task_edges)
    for n, k in ((12, 14), (40, 60)):
        e = [(rng.randrange(n), rng.randrange(n)) for _ in range(k)] + [(5, 5), (5, 5)]
        nodes, far = reach(e)
        df = frame(spark, e)
        got = {r["node"]: r["scc"] for r in graph.strongly_connected(df, task_edges=task_edges).collect()}
        assert got == {v: min(u for u in nodes if u in far[v] and v in far[u]) for v in nodes}
        _, far = reach(e + [(b, a) for a, b in e])
        got = {r["node"]: r["part"] for r in graph.weak_parts(df, task_edges).collect()}
        assert got == {v: min(far[v]) for v in nodes}
    empty = frame(spark, [])
    assert graph.strongly_connected(empty, task_edges=task_edges).count() == 0 and graph.weak_parts(empty, task_edges).count() == 0


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("part_edges", [0, 6, graph.PART_EDGES])
def test_distances_against_a_plain_search(spark, kind, part_edges):
    rng = random.Random(part_edges)
    e = [(g * 10 + rng.randrange(9), g * 10 + rng.randrange(9)) for g in range(8) for _ in range(rng.randrange(14))]
    nodes, far = reach([(b, a) for a, b in e])
    name = (lambda v: v) if kind == "long" else (lambda v: f"n{v}")
    starts = spark.createDataFrame([(name(v),) for v in [*sorted(nodes)[::2], 999, sorted(nodes)[0]]] + [(None,)], f"start {kind}")
    for depth in (None, 2):
        got = {(r["start"], r["path"]): r["distance"] for r in graph.dependents_by(frame(spark, e, kind), starts, depth, part_edges=part_edges).collect()}
        assert got == {(name(s), name(v)): d for s in sorted(nodes)[::2] for v, d in far[s].items() if d and (depth is None or d <= depth)}


def test_many_starts_and_long_parts(spark, monkeypatch):
    monkeypatch.setattr(graph, "STARTS", 7)
    n = 300
    df = frame(spark, [(i + 1, i) for i in range(n)] + [(1000 + i, 1000 + i // 2) for i in range(1, 300)])
    starts = spark.createDataFrame([(i,) for i in [*range(0, n, 10), *range(1000, 1100)]], "start long")
    got = {(r["start"], r["path"]): r["distance"] for r in graph.dependents_by(df, starts).collect()}
    assert sum(s < 1000 for s, _ in got) == sum(n - s for s in range(0, n, 10)) and all(d == p - s for (s, p), d in got.items() if s < 1000)
    assert got[(1000, 1256)] == 9 and (1001, 1000) not in got


def jobs(spark, f):
    spark.sparkContext.setJobGroup("counted", "")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    out = f()
    spark.sparkContext.setJobGroup("other", "")
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted")) - before


def test_a_long_chain_takes_few_jobs(spark):
    """Labels of labels double their reach: a chain of thousands is settled in a few rounds, and in one task if it fits."""
    n = 6000
    chain = frame(spark, [(i, i + 1) for i in range(n)] + [(n + 1, 0)])
    got, few = jobs(spark, lambda: graph.strongly_connected(chain, task_edges=0).where("node <> scc").count())
    assert got == 0 and few < 400  # adaptive execution counts each shuffle as a job
    ring = frame(spark, [(i, (i + 1) % 100_000) for i in range(100_000)])
    got, few = jobs(spark, lambda: graph.strongly_connected(ring).where("scc = 0").count())
    assert got == 100_000 and few < 10
