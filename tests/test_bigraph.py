"""Graphs of large incidents: rounds over blocks against the kernels and against brute force."""

import math
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from kestrelog.operators import bigraph, graph

NOON = datetime(2026, 5, 1, 12, tzinfo=timezone.utc)


def incidents():
    """name -> (events, edges): a forward graph, one with a few edges back, one of large cycles, a chain, one
    vertex with very many edges, and a single event."""
    r, out = random.Random(4), {}

    def made(n, pairs):
        at = sorted(r.randrange(10**6) for _ in range(n))
        return [(f"e{i}", at[i], i, r.choice([20, 30, 40, 50])) for i in range(n)], {p: round(r.uniform(0.2, 0.99), 3) for p in pairs}

    n = 40
    forward = {tuple(sorted(r.sample(range(n), 2))) for _ in range(90)}
    out["forward"] = made(n, forward)
    back = {tuple(sorted(r.sample(range(n), 2))) for _ in range(60)} | {(12, 8), (20, 19), (33, 30)}
    out["back"] = made(n, back)
    wild = {tuple(r.sample(range(n), 2)) for _ in range(70)}
    out["wild"] = made(n, wild)
    out["chain"] = made(30, {(i, i + 1) for i in range(29)} | {(3, 3)})
    out["hub"] = made(30, {(i, 25) for i in range(25)} | {(25, i) for i in range(26, 30)})
    out["one"] = made(1, set())
    return out


@pytest.fixture(scope="module")
def frames(spark):
    v = [(name, f"{name}-{e}", NOON + timedelta(microseconds=t), i, sev, None) for name, (events, _) in incidents().items() for e, t, i, sev in events]
    e = [(name, f"{name}-e{a}", f"{name}-e{b}", s) for name, (_, edges) in incidents().items() for (a, b), s in edges.items()]
    v = spark.createDataFrame(v, "incident_id string, event_id string, timestamp timestamp, ord int, severity int, boost double")
    return v, spark.createDataFrame(e, "incident_id string, source_event string, target_event string, composite_score double")


@pytest.fixture(scope="module")
def big(frames):
    return bigraph.number(*frames, block=25, stretch=30)


def reached(edges, start):
    seen, work = set(), [start]
    while work:
        for a, b in edges:
            if a == work[-1] and b not in seen:
                seen.add(b)
                work.append(b)
                break
        else:
            work.pop()
    return seen


def test_blocks_are_bounded_and_in_order(big):
    rows = big.vertices.orderBy("id").collect()
    assert [r.id for r in rows] == list(range(len(rows)))
    assert [(r.incident_id, r.timestamp) for r in rows] == sorted((r.incident_id, r.timestamp) for r in rows)
    assert [r.block for r in rows] == sorted(r.block for r in rows) and len({r.block for r in rows}) > 10
    inside = big.edges.filter("sb = tb").groupBy("tb").count().agg(F.max("count")).first()[0]
    assert inside <= 25


def test_components_equal_brute_force(big):
    ids = {r.id: r.event_id for r in big.vertices.collect()}
    got = {ids[r.id]: ids[r.comp] for r in bigraph.components(big).collect()}
    for name, (events, edges) in incidents().items():
        after = {i: reached(edges, i) for i in range(len(events))}
        for i in range(len(events)):
            assert got[f"{name}-e{i}"] == f"{name}-e{min([i, *(j for j in after[i] if i in after[j])])}"


def test_root_candidates_equal_the_kernel(frames, big):
    rule = lambda part, early, impact: graph.REACH * part + graph.EARLY * early + graph.IMPACT * impact
    key = lambda r: tuple(round(x, 4) if isinstance(x, float) else x for x in r)
    got = sorted(map(key, bigraph.root_candidates(big, graph._weight(), rule, 3).collect()))
    assert got == sorted(map(key, graph.root_candidates(*frames, top=3).collect())) and len(got) > 12


def test_root_candidates_of_many_roots_take_several_passes(spark, monkeypatch):
    """More roots than one pass counts, of which late ones reach most."""
    monkeypatch.setattr(bigraph, "ROOTS", 4)
    n = 30
    v = spark.createDataFrame([("i", f"e{k:02}", NOON + timedelta(seconds=k), k, 40, None) for k in range(n)], "incident_id string, event_id string, timestamp timestamp, ord int, severity int, boost double")
    e = spark.createDataFrame([("i", f"e{k:02}", f"e{j:02}", 0.5) for k in range(15) for j in range(15, 15 + k)], "incident_id string, source_event string, target_event string, composite_score double")
    rule = lambda part, early, impact: graph.REACH * part + graph.EARLY * early + graph.IMPACT * impact
    got = [(r.rank, r.event_id, r.score, r.members) for r in bigraph.root_candidates(bigraph.number(v, e, 10, 10), graph._weight(), rule, 5).orderBy("rank").collect()]
    assert got == [(r.rank, r.event_id, r.score, r.members) for r in graph.root_candidates(v, e).orderBy("rank").collect()]


def test_timelines_are_topological_and_equal_the_kernel(frames, big):
    got = {(r.incident_id, r.position): r.event_id for r in bigraph.timelines(big).collect()}
    assert got == {(r.incident_id, r.position): r.event_id for r in graph.timelines(*frames).collect()}
    place = {e: k for (_, k), e in got.items()}
    for name, (events, edges) in incidents().items():
        after = {i: reached(edges, i) for i in range(len(events))}
        assert all(place[f"{name}-e{a}"] < place[f"{name}-e{b}"] for a, b in edges if a not in after[b] and a != b)
    assert [got["forward", k] for k in range(40)] == [f"forward-e{k}" for k in range(40)]  # without edges back: the order of time


def test_strongest_chains_equal_the_kernel(spark, frames, big):
    r = random.Random(2)
    asked = [(name, f"{name}-e{r.randrange(len(ev))}", f"{name}-e{r.randrange(len(ev))}") for name, (ev, _) in incidents().items() for _ in range(5)]
    asked = sorted({*asked, ("forward", "forward-e0", "nothing"), ("one", "one-e0", "one-e0"), ("chain", "chain-e0", "chain-e29")})
    ends = spark.createDataFrame(asked, "incident_id string, source string, sink string")
    key = lambda x: (x.incident_id, x.source, x.sink, x.path, round(x.strength, 9))
    got = sorted(map(key, bigraph.strongest_chains(big, ends).collect()))
    assert got == sorted(map(key, graph.strongest_chains(*frames, ends).collect())) and [x[:3] for x in got] == asked
    for name, source, sink, path, strength in got:
        scores = incidents()[name][1]
        steps = [(int(a.split("-e")[1]), int(b.split("-e")[1])) for a, b in zip(path, path[1:])]
        assert not path or (path[0], path[-1]) == (source, sink) and abs(math.prod(scores[s] for s in steps) - strength) < 1e-9
    assert any(len(x[3]) > 3 for x in got) and any(not x[3] for x in got)


def test_estimates_of_reach(spark):
    """A chain of 400 events: the estimates' spread is as stated."""
    n = 400
    v = spark.createDataFrame([("i", f"e{k:03}", NOON + timedelta(seconds=k), k, 40, None) for k in range(n)], "incident_id string, event_id string, timestamp timestamp, ord int, severity int, boost double")
    e = spark.createDataFrame([("i", f"e{k:03}", f"e{k + 1:03}", 0.5) for k in range(n - 1)], "incident_id string, source_event string, target_event string, composite_score double")
    c = bigraph.condense(bigraph.number(v, e, block=150))
    got = {r.id: r.below for r in bigraph.estimated(c).collect()}
    assert got[n - 1] < 2 and all(0.4 < (got[k] + 1) / (n - k) < 2 for k in range(0, 300, 7))


def test_large_incidents_go_by_blocks_and_small_ones_by_kernels(frames):
    """The same rows whatever the limit; only reach becomes an estimate."""
    some = [df.filter("incident_id in ('wild', 'one', 'chain')") for df in frames]
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(graph.timelines(*some, limit=60)) == key(graph.timelines(*some))
    found = {r.event_id: r for r in graph.reach(*some, limit=60).collect()}
    for r in graph.reach(*some).collect():
        assert found[r.event_id].component == r.component and (r.incident_id == "wild" or found[r.event_id].reach == r.reach)
