"""Evidence graphs: one kernel call per incident, so that incidents spread over the cluster, and rounds over
blocks (:mod:`kestrelog.operators.bigraph`) for incidents that are too large for one task.

Vertices (incident_id, event_id, timestamp, ord, severity, service) and edges (incident_id, source_event,
target_event, composite_score) are DataFrames; a whole graph never meets the driver.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrelog.operators import bigraph
from kestrelog.session import settled

#: Weights of a root candidate's parts and of severities.
REACH, EARLY, IMPACT = 0.45, 0.30, 0.25
#: Events and edges of an incident up to which one task has it whole.
LIMIT = 2_000_000


def build(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges, the last of each pair (by ``ord``, if there is one); unknown end points are an error."""
    ends = edges.select("incident_id", F.explode(F.array("source_event", "target_event")).alias("event_id"))
    strange = ends.join(vertices, ["incident_id", "event_id"], "left_anti").limit(1).collect()
    if strange:
        raise ValueError(f"edge with an unknown event: {strange[0].event_id}")
    last = F.col("ord") if "ord" in edges.columns else F.lit(0)
    return edges.groupBy("incident_id", "source_event", "target_event").agg(F.max_by("composite_score", last).alias("composite_score"))


def prune(vertices: DataFrame, edges: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Without weak edges, then without vertices that no edge touches."""
    edges = edges.filter(F.col("composite_score") >= least)
    ends = edges.select("incident_id", F.explode(F.array("source_event", "target_event")).alias("event_id")).distinct()
    return vertices.join(ends, ["incident_id", "event_id"], "left_semi"), edges


def components_of(n: int, out: list[list[int]]) -> list[int]:
    """Strongly connected component of each vertex, numbered in reverse topological order (Tarjan)."""
    index, low, comp = [-1] * n, [0] * n, [-1] * n
    stack: list[int] = []
    count = found = 0
    for root in range(n):
        if index[root] >= 0:
            continue
        work = [(root, iter(out[root]))]
        index[root] = low[root] = count
        count += 1
        stack.append(root)
        while work:
            v, more = work[-1]
            for w in more:
                if index[w] < 0:
                    index[w] = low[w] = count
                    count += 1
                    stack.append(w)
                    work.append((w, iter(out[w])))
                    break
                if comp[w] < 0:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    while True:
                        w = stack.pop()
                        comp[w] = found
                        if w == v:
                            break
                    found += 1
    return comp


def digits(x: float) -> float:
    """``x``, not negative, to four digits, halves up as in SQL; round() takes many of them down."""
    whole = math.floor(x * 1e4)
    return (whole + (x * 1e4 - whole >= 0.5)) / 1e4


class Graph:
    """One incident's graph in memory."""

    def __init__(self, vertices: pd.DataFrame, edges: pd.DataFrame):
        v = vertices.sort_values(["timestamp", "ord", "event_id"]).reset_index(drop=True)
        if v["timestamp"].isna().any():
            raise ValueError("event without a timestamp")
        self.ids, self.at = v["event_id"].tolist(), [t.value // 1000 for t in v["timestamp"]]  # whole microseconds
        self.rows = v
        place = {e: i for i, e in enumerate(self.ids)}
        self.place = place
        self.out: list[list[int]] = [[] for _ in self.ids]
        self.score: dict[tuple[int, int], float] = {}
        for s, t, c in zip(edges["source_event"], edges["target_event"], edges["composite_score"]):
            if s in place and t in place:
                self.out[place[s]].append(place[t])
                self.score[place[s], place[t]] = c
        self.comp = components_of(len(self.ids), self.out)
        self.size = max(self.comp, default=-1) + 1
        self.members: list[list[int]] = [[] for _ in range(self.size)]
        for i, c in enumerate(self.comp):
            self.members[c].append(i)
        self.next = [sorted({self.comp[w] for i in m for w in self.out[i]} - {c}) for c, m in enumerate(self.members)]

    def below(self) -> list[int]:
        """For each component the vertices of all components that it reaches, as bits."""
        reach = [0] * self.size
        for c in range(self.size):  # reverse topological: what comes after is done
            for d in self.next[c]:
                reach[c] |= reach[d] | sum(1 << i for i in self.members[d])
        return reach

    def roots(self, boost: dict, top: int) -> list[tuple]:
        n = len(self.ids)
        if not n:
            return []
        entered = {d for c in range(self.size) for d in self.next[c]}
        reach, low, span = self.below(), min(self.at), max((max(self.at) - min(self.at)) / 1e6, 1e-9)
        out = []
        for c in range(self.size):
            if c in entered:
                continue
            first = self.members[c][0]
            part = (reach[c].bit_count() + len(self.members[c])) / n
            early = 1 - (self.at[first] - low) / 1e6 / span
            weight = lambda s: 1.0 if s >= 50 else 0.9 if s >= 40 else 0.6 if s >= 30 else 0.3
            impact = max(max(weight(self.rows["severity"][i]), boost.get(self.ids[i], 0.0)) for i in self.members[c])
            total = digits(REACH * part + EARLY * early + IMPACT * impact)
            out.append((-total, first, digits(part), digits(early), impact, len(self.members[c])))
        return [(self.ids[f], -t, r, e, i, k) for t, f, r, e, i, k in sorted(out)[:top]]

    def chain(self, source, sink) -> tuple[list, float]:
        """The path with the largest product of scores, and that product; empty if there is none. Of equal
        ones the shortest counts, then the one whose events come first, seen from its end."""
        if source not in self.place or sink not in self.place:
            return [], 0.0
        a, b = self.place[source], self.place[sink]
        best, heap, done = {a: (0.0, 0)}, [(0.0, 0, a)], set()
        while heap:
            cost, hops, v = heapq.heappop(heap)
            if v in done:
                continue
            done.add(v)
            for w in self.out[v]:
                c = (cost - math.log(max(self.score[v, w], 1e-6)), hops + 1)
                if w not in best or c < best[w]:
                    best[w] = c
                    heapq.heappush(heap, (*c, w))
        if b not in best:
            return [], 0.0
        into: dict[int, list[int]] = {}
        for v, w in self.score:
            if v in best and (best[v][0] - math.log(max(self.score[v, w], 1e-6)), best[v][1] + 1) == best[w]:
                into.setdefault(w, []).append(v)
        path = [b]
        while path[-1] != a:
            path.append(min(into[path[-1]]))
        return [self.ids[v] for v in reversed(path)], math.exp(-best[b][0])

    def timeline(self) -> list:
        """Components by the latest event that must come before or with them, then by the steps since, then by
        their own first event; inside one by time. Without edges back in time that is the order of time."""
        key = [(m[0], 0) for m in self.members]
        for c in range(self.size - 1, -1, -1):  # topological
            for d in self.next[c]:
                key[d] = max(key[d], (key[c][0], key[c][1] + 1)) if key[c][0] >= self.members[d][0] else key[d]
        order = sorted(range(self.size), key=lambda c: (*key[c], self.members[c][0]))
        return [self.ids[i] for c in order for i in self.members[c]]


def _split(vertices: DataFrame, edges: DataFrame, limit: int) -> tuple[DataFrame, DataFrame, bigraph.Big | None]:
    """Vertices and edges of the incidents that one task can have, and the graph of the larger ones, if any."""
    if "boost" not in vertices.columns:
        vertices = vertices.withColumn("boost", F.lit(None).cast("double"))
    vertices, edges = settled(vertices, "vertices"), settled(edges, "edges")
    sizes = vertices.groupBy("incident_id").count().union(edges.groupBy("incident_id").count())
    large = settled(sizes.groupBy("incident_id").agg(F.sum("count").alias("n")).filter(F.col("n") > limit).select("incident_id"), "large")
    if large.isEmpty():
        return vertices, edges, None
    v, e = (df.join(large, "incident_id", "left_semi") for df in (vertices, edges))
    small = [df.join(large, "incident_id", "left_anti") for df in (vertices, edges)]
    return *small, bigraph.number(v, e)


def _per_incident(vertices: DataFrame, edges: DataFrame, run, schema: str) -> DataFrame:
    # both may come from one table: fresh columns keep them apart
    vertices = vertices.select(*[F.col(c).alias(c, metadata={"side": "vertices"}) for c in vertices.columns])
    return vertices.groupBy("incident_id").cogroup(edges.groupBy("incident_id")).applyInPandas(run, schema)


def reach(vertices: DataFrame, edges: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(incident_id, event_id, component, reach): the component's smallest event in time order, and how
    many events it leads to outside itself. In incidents of over ``limit`` events and edges reach is an
    estimate with a standard error of 18 %, since counts for all events would need their pairs."""
    vertices, edges, big = _split(vertices, edges, limit)

    def run(v: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        g = Graph(v, e)
        below = g.below()
        rows = [(v["incident_id"].iloc[0], x, g.ids[g.members[g.comp[i]][0]], below[g.comp[i]].bit_count()) for i, x in enumerate(g.ids)] if len(v) else []
        return pd.DataFrame(rows, columns=["incident_id", "event_id", "component", "reach"])

    out = _per_incident(vertices, edges, run, "incident_id string, event_id string, component string, reach long")
    if big is None:
        return out
    c = bigraph.condense(big)
    about = bigraph.estimated(c).join(c.nodes.select("id", F.col("event_id").alias("component")), "id").select(F.col("id").alias("comp"), "component", F.round("below").cast("long").alias("reach"))
    return out.union(big.vertices.select("incident_id", "event_id", "id").join(c.comp, "id").join(about, "comp").select("incident_id", "event_id", "component", "reach"))


def _weight() -> Column:
    by = F.when(F.col("severity") >= 50, 1.0).when(F.col("severity") >= 40, 0.9).when(F.col("severity") >= 30, 0.6).otherwise(0.3)
    return F.greatest(by, F.coalesce("boost", F.lit(0.0)))


def root_candidates(vertices: DataFrame, edges: DataFrame, boost: DataFrame | None = None, top: int = 5, limit: int = LIMIT) -> DataFrame:
    """The likeliest first causes of each incident, best first (rank from 1)."""
    if boost is not None:
        vertices = vertices.join(boost.select("event_id", "boost"), "event_id", "left")
    vertices, edges, big = _split(vertices, edges, limit)

    def run(v: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        names = ["incident_id", "rank", "event_id", "score", "reach", "earliness", "impact", "members"]
        if not len(v):
            return pd.DataFrame([], columns=names)
        known = {i: b for i, b in zip(v["event_id"], v["boost"]) if b == b and b is not None}
        return pd.DataFrame([(v["incident_id"].iloc[0], k, *r) for k, r in enumerate(Graph(v, e).roots(known, top), 1)], columns=names)

    out = _per_incident(vertices, edges, run, "incident_id string, rank int, event_id string, score double, reach double, earliness double, impact double, members long")
    if big is None:
        return out
    return out.union(bigraph.root_candidates(big, _weight(), lambda part, early, impact: REACH * part + EARLY * early + IMPACT * impact, top))


def strongest_chains(vertices: DataFrame, edges: DataFrame, ends: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(incident_id, source, sink, path, strength) for the rows of ``ends`` (incident_id, source, sink)."""
    vertices, edges, big = _split(vertices, edges, limit)
    wanted = ends.groupBy(F.col("incident_id").alias("_i")).agg(F.collect_list(F.struct("source", "sink")).alias("ends"))
    vertices = vertices.join(wanted, F.col("incident_id") == F.col("_i")).drop("_i")

    def run(v: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(v):
            g = Graph(v, e)
            for pair in v["ends"].iloc[0]:
                path, strength = g.chain(pair["source"], pair["sink"])
                rows.append((v["incident_id"].iloc[0], pair["source"], pair["sink"], path, strength))
        return pd.DataFrame(rows, columns=["incident_id", "source", "sink", "path", "strength"])

    out = _per_incident(vertices, edges, run, "incident_id string, source string, sink string, path array<string>, strength double")
    if big is None:
        return out
    return out.union(bigraph.strongest_chains(big, ends.join(big.vertices.select("incident_id").distinct(), "incident_id", "left_semi")))


def timelines(vertices: DataFrame, edges: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(incident_id, position, event_id): causes before effects, and otherwise by time."""
    vertices, edges, big = _split(vertices, edges, limit)

    def run(v: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        rows = [(v["incident_id"].iloc[0], k, x) for k, x in enumerate(Graph(v, e).timeline())] if len(v) else []
        return pd.DataFrame(rows, columns=["incident_id", "position", "event_id"])

    out = _per_incident(vertices, edges, run, "incident_id string, position long, event_id string")
    return out if big is None else out.union(bigraph.timelines(big))


def sinks(vertices: DataFrame) -> DataFrame:
    """The latest event at error or worse of each incident."""
    return vertices.filter("severity >= 40").groupBy("incident_id").agg(F.max_by("event_id", F.struct("timestamp", "ord")).alias("sink"))
