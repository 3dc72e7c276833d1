"""From events to an evidence bundle: the whole chain, and the bundle as text."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelog.operators import correlate, detect, graph
from kestrelog.operators.query import dependencies, interesting
from kestrelog.session import settled


@dataclass
class Analysis:
    """DataFrames of one run. Clusters, vertices and edges are read from tables."""

    events: DataFrame
    clusters: DataFrame
    vertices: DataFrame
    edges: DataFrame
    dependencies: DataFrame
    boosts: DataFrame


def analyse(events: DataFrame, deps: DataFrame, s: detect.Settings = detect.Settings(), incident_id: str = "incident") -> Analysis:
    """The chain up to the pruned graph. Each step reads the table of the one before: a single plan would hold
    that of ``events`` some forty times, and Spark would take minutes to analyse it."""
    clusters = settled(detect.detect(events, s), "clusters")
    kept = settled(interesting(events, clusters), "kept")
    edges = settled(correlate.correlate(kept, deps).withColumn("incident_id", F.lit(incident_id)), "edges")
    vertices = kept.withColumn("incident_id", F.lit(incident_id))
    vertices, edges = graph.prune(vertices, edges, correlate.LEAST)
    return Analysis(events, clusters, vertices, edges, deps, detect.boosts(clusters))


@dataclass
class Bundle:
    """The reduced evidence of one incident; small, at the driver."""

    start: object
    end: object
    services: list[str]
    depends_on: dict[str, list[str]]
    clusters: list
    candidates: list
    chains: list[list]
    similar: list[str] = field(default_factory=list)


def bundle(a: Analysis, top: int = 3) -> Bundle:
    span = a.events.agg(F.min("timestamp").alias("start"), F.max("timestamp").alias("end"), F.array_sort(F.collect_set("service")).alias("services")).first()
    if span.start is None:
        raise ValueError("no events")
    clusters = a.clusters.orderBy(*detect.CLUSTER_ORDER).collect()
    slim = a.vertices.select("incident_id", "event_id", "timestamp", "ord", "severity", "service")
    found = graph.root_candidates(slim, a.edges, a.boosts, top).orderBy("rank").collect()
    sink = graph.sinks(slim).first()
    chains = []
    if sink and found:
        ends = a.events.sparkSession.createDataFrame([(c.incident_id, c.event_id, sink.sink) for c in found], "incident_id string, source string, sink string")
        by = {r.source: r.path for r in graph.strongest_chains(slim, a.edges, ends).collect()}
        chains = [by[c.event_id] for c in found if by.get(c.event_id)]
    names = {e for c in chains for e in c} | {c.event_id for c in found}
    about = {r.event_id: r for r in a.events.filter(F.col("event_id").isin(list(names))).collect()} if names else {}
    on = {r.name: r.depends_on for r in dependencies(a.dependencies).collect() if r.depends_on}
    return Bundle(span.start, span.end, list(span.services), on, clusters, [(c, about.get(c.event_id)) for c in found], [[about[e] for e in c] for c in chains])


def render(b: Bundle) -> str:
    """The bundle as plain text, a section each."""
    out = [f"Window: {b.start.isoformat()} to {b.end.isoformat()}", "Services: " + ", ".join(b.services), "", "Dependencies:"]
    out += [f"  {s}: {', '.join(d)}" for s, d in sorted(b.depends_on.items())]
    out += ["", "Anomalies:"]
    out += [f"  {c.kind} in {c.service}: {c.event_count} events from {c.window_start:%H:%M:%S} to {c.window_end:%H:%M:%S}, confidence {c.confidence:.2f}" for c in b.clusters]
    out += ["", "Root candidates:"]
    out += [f"  {c.rank}. {e.service} {e.message[:90]} (score {c.score}, reach {c.reach}, earliness {c.earliness})" for c, e in b.candidates if e]
    for chain in b.chains:
        out += ["", "Chain:"] + [f"  {e.timestamp:%H:%M:%S} {e.service}: {e.message[:90]}" for e in chain]
    return "\n".join(out + (["", "Similar incidents:"] + [f"  {x}" for x in b.similar] if b.similar else []))
