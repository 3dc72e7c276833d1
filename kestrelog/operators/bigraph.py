"""Evidence graphs of incidents that are too large for one task.

All large incidents are one graph: vertices get positions in order of incident and time, and consecutive
positions form blocks of a bounded number of vertices and edges that end in them. :func:`spread` carries values
along edges until nothing changes: each round a block reaches its own fixed point in one task, and what
crosses blocks is aggregated by Spark before it is delivered, so a vertex with very many edges stays bounded.
Edges of evidence mostly lead to near, later blocks: rounds follow the number of blocks on a path, not its
length. Every round is a shared table, so lost executors cost a task and not the run. The driver holds one
row a block and one row an incident.

Results are those of the kernels in :mod:`kestrelog.operators.graph`, for cyclic graphs as well.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrelog.session import discard, settled

#: Vertices and in-edges of a block; edges of a cyclic stretch up to which one task finds its components.
BLOCK, STRETCH = 200_000, 1_000_000
#: Roots whose reach one pass counts, chains that one pass finds, and draws of an estimate.
ROOTS, CHAINS, DRAWS = 62, 4, 32
FAR = 1 << 62


@dataclass
class Big:
    """vertices (incident_id, event_id, timestamp, severity, boost, id, block) and edges (s, sb, t, tb, w) by position."""

    vertices: DataFrame
    edges: DataFrame
    block: int = BLOCK
    stretch: int = STRETCH


def _offsets(sorted_: DataFrame, *weights: Column) -> DataFrame:
    """(part, base0, base1, ...): sums of the weights over the parts before; one row a part at the driver."""
    rows = sorted(sorted_.groupBy("part").agg(*(F.sum(w).alias(f"x{i}") for i, w in enumerate(weights))).collect())
    total, out = [0] * len(weights), []
    for part, *values in rows:
        out.append((part, *total))
        total = [a + b for a, b in zip(total, values)]
    return sorted_.sparkSession.createDataFrame(out, "part int, " + ", ".join(f"base{i} long" for i in range(len(weights))))


def _in_order(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    """``rows`` with ``place``, their global places in order of ``keys`` from 0, and ``load``, the sum of
    their ``weight`` up to and with each. Ranges are sorted each by itself."""
    parts = max(1, -(-rows.count() // size))
    held = settled(rows.repartitionByRange(parts, *keys).withColumn("part", F.spark_partition_id()), "ordered")
    own = Window.partitionBy("part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    out = held.withColumn("n", F.count("*").over(own)).withColumn("load", F.sum("weight").over(own))
    out = out.join(_offsets(held, F.lit(1), F.col("weight")), "part")
    return out.withColumn("place", F.col("base0") + F.col("n") - 1).withColumn("load", F.col("base1") + F.col("load")).drop("part", "n", "base0", "base1")


def number(vertices: DataFrame, edges: DataFrame, block: int = BLOCK, stretch: int = STRETCH) -> Big:
    """Vertices (incident_id, event_id, timestamp, ord, severity, boost) and edges as a :class:`Big` graph."""
    entering = edges.groupBy("incident_id", F.col("target_event").alias("event_id")).agg(F.count("*").alias("entering"))
    weighed = vertices.join(entering, ["incident_id", "event_id"], "left").withColumn("weight", 1 + F.coalesce("entering", F.lit(0)))
    placed = _in_order(weighed, ["incident_id", "timestamp", "ord", "event_id"], 5 * block)
    v = placed.select("incident_id", "event_id", "timestamp", "severity", "boost", F.col("place").alias("id"), F.expr(f"(load - 1) div {block}").cast("long").alias("block"))
    v = settled(v, "vertices")

    def ends(name: str, i: str, b: str) -> DataFrame:
        return v.select("incident_id", F.col("event_id").alias(name), F.col("id").alias(i), F.col("block").alias(b))

    e = edges.join(ends("source_event", "s", "sb"), ["incident_id", "source_event"]).join(ends("target_event", "t", "tb"), ["incident_id", "target_event"])
    e = e.filter("s <> t").groupBy("s", "sb", "t", "tb").agg(F.max("composite_score").alias("score"))
    return Big(v, settled(e.withColumn("w", -F.log(F.greatest("score", F.lit(1e-6)))).drop("score"), "edges"), block, stretch)


FOLD = {"min": (np.minimum, F.min, lambda a, b: a < b), "max": (np.maximum, F.max, lambda a, b: a > b), "or": (np.bitwise_or, F.bit_or, lambda a, b: a.bitwiseOR(b) != b)}


def spread(values: DataFrame, edges: DataFrame, fold: str, step: bool = False) -> DataFrame:
    """The least fixed point of v[t] = fold(v[t], v[s] + w) over ``edges(s, sb, t, tb, w)``, from ``values(id,
    block, v0, v1, ...)``; w counts only with ``step``. Columns are all long or all double."""
    names = [c for c in values.columns if c.startswith("v")]
    kind = dict(values.dtypes)[names[0]]
    union, aggregate, better = FOLD[fold]
    dtype, sql = (np.float64, "double") if kind == "double" else (np.int64, "long")
    ddl = "id long, block long, " + ", ".join(f"{n} {sql}" for n in names) + ", changed boolean"
    if not step:
        edges = edges.withColumn("w", F.lit(0).cast(sql))
    edges = edges.select("s", "sb", "t", "tb", F.col("w").cast(sql).alias("w"))
    inner = edges.filter("sb = tb").select(F.col("tb").alias("block"), "s", "t", "w", *(F.lit(0).cast(sql).alias(n) for n in names))
    cross = edges.filter("sb <> tb")

    def close(v: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        v = v.sort_values("id", ignore_index=True)
        ids, old = v["id"].to_numpy(), v[names].to_numpy(dtype)
        now = old.copy()
        come = e["s"].to_numpy() < 0  # what other blocks send
        if come.any():
            union.at(now, np.searchsorted(ids, e["t"].to_numpy()[come]), e.loc[come, names].to_numpy(dtype))
        s, t = (np.searchsorted(ids, e[c].to_numpy()[~come]) for c in "st")
        w = e["w"].to_numpy()[~come].astype(dtype)[:, None]
        fresh = np.ones(len(ids), bool)
        while len(s) and fresh.any():
            go = fresh[s]
            before = now.copy()
            union.at(now, t[go], now[s[go]] + w[go] if step else now[s[go]])
            fresh = (now != before).any(axis=1)
        out = pd.DataFrame(now, columns=names)
        return out.assign(id=ids, block=v["block"], changed=(now != old).any(axis=1))[["id", "block", *names, "changed"]]

    values = values.select("id", "block", *names)
    state = settled(values.groupBy("block").cogroup(inner.groupBy("block")).applyInPandas(close, ddl), "spread")
    moved, stale = state, None
    while True:
        gone = cross.join(moved.select(F.col("id").alias("s"), *names), "s")
        inbox = gone.groupBy("t", "tb").agg(*(aggregate(F.col(n) + F.col("w") if step else F.col(n)).alias(f"n{n}") for n in names))
        known = state.select(F.col("id").alias("t"), *names)
        gain = [better(F.col(f"n{n}"), F.col(n)) for n in names]
        news = inbox.join(known, "t").filter(F.exists(F.array(*gain), lambda x: x))
        news = settled(news.select(F.col("tb").alias("block"), F.lit(-1).cast("long").alias("s"), "t", F.lit(0).cast(sql).alias("w"), *(F.col(f"n{n}").alias(n) for n in names)), "inbox")
        if stale is not None:
            discard(stale)
        if news.isEmpty():
            discard(news)
            return state.drop("changed")
        active = news.select("block").distinct()
        told = inner.join(active, "block", "left_semi").unionByName(news)
        part = state.join(active, "block", "left_semi").select("id", "block", *names)
        new = settled(part.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(close, ddl), "spread")
        whole = settled(state.join(active, "block", "left_anti").unionByName(new), "spread")
        discard(state)
        discard(news)
        state, stale, moved = whole, new, new.filter("changed")


def _turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("t").alias("s"), F.col("tb").alias("sb"), F.col("s").alias("t"), F.col("sb").alias("tb"), "w")


def _running(v: DataFrame, x: Column, name: str) -> DataFrame:
    """``v(id, block)`` with ``name``: the largest x of all positions before, and ``name``_here with its own."""
    held = v.withColumn("_x", x)
    most, rows = None, []
    for block, value in sorted(held.groupBy("block").agg(F.max("_x")).collect()):  # one row a block
        rows.append((block, most))
        most = value if most is None else max(most, value) if value is not None else most
    before = v.sparkSession.createDataFrame(rows, "block long, _before long")
    own = Window.partitionBy("block").orderBy("id")
    out = held.join(before, "block")
    out = out.withColumn(name, F.greatest("_before", F.max("_x").over(own.rowsBetween(Window.unboundedPreceding, -1))))
    return out.withColumn(f"{name}_here", F.greatest(name, "_x")).drop("_x", "_before")


def _tarjan(e: pd.DataFrame) -> pd.DataFrame:
    from kestrelog.operators.graph import components_of

    ids = np.unique(np.r_[e["s"], e["t"]])
    out: list[list[int]] = [[] for _ in ids]
    for a, b in zip(np.searchsorted(ids, e["s"]).tolist(), np.searchsorted(ids, e["t"]).tolist()):
        out[a].append(b)
    comp = pd.Series(components_of(len(ids), out))
    return pd.DataFrame({"id": ids, "comp": pd.Series(ids).groupby(comp).transform("min")})


def _coloured(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round on the edges of large cyclic stretches: everyone takes the smallest position that leads to it as
    colour; those of a colour that lead back to it are its component. (id, comp) of these, and the edges within
    a colour that touch none of them: no cycle leads through others."""
    ends = edges.select(F.col("s").alias("id"), F.col("sb").alias("block")).union(edges.select("t", "tb")).distinct()
    colour = spread(ends.withColumn("v0", F.col("id")), edges, "min").select("id", "block", F.col("v0").alias("colour"))
    s, t = (colour.select(F.col("id").alias(c), F.col("colour").alias(f"{c}c")) for c in "st")
    same = settled(edges.join(s, "s").join(t, "t").filter("sc = tc").select(*edges.columns), "same")
    mark = spread(colour.withColumn("v0", (F.col("id") == F.col("colour")).cast("long")), _turned(same), "max").filter("v0 = 1").select("id")
    done = settled(colour.join(mark, "id").select("id", F.col("colour").alias("comp")), "components")
    gone = done.select("id")
    return done, settled(same.join(gone, F.col("s") == F.col("id"), "left_anti").join(gone, F.col("t") == F.col("id"), "left_anti"), "live")


def components(g: Big) -> DataFrame:
    """(id, comp): strongly connected components, named by their smallest position.

    A cycle needs an edge that leads back, and lies within the positions that such edges span: elsewhere every
    vertex is alone, without a single round. Each stretch of overlapping spans is one task's, if it is small;
    large ones are coloured, and what is left of them is looked at anew.
    """
    single, live, found = g.vertices.select("id", F.col("id").alias("comp")), g.edges, []
    while not (back := live.filter("t < s").groupBy(F.col("t").alias("id")).agg(F.max("s").alias("far"))).isEmpty():
        v = g.vertices.select("id", "block").join(back, "id", "left")
        v = _running(v, F.coalesce("far", "id"), "far_before")
        starts = F.when(F.col("far_before").isNull() | (F.col("far_before") < F.col("id")), F.col("id"))
        v = settled(_running(settled(v.select("id", "block", starts.alias("start")), "starts"), F.col("start"), "stretch").select("id", F.col("stretch_here").alias("stretch")), "stretches")
        s, t = (v.select(F.col("id").alias(c), F.col("stretch").alias(f"{c}g")) for c in "st")
        inside = settled(live.join(s, "s").join(t, "t").filter("sg = tg").select(*live.columns, F.col("sg").alias("stretch")), "inside")
        sizes = inside.groupBy("stretch").count()
        small, large = (inside.join(sizes.filter(c), "stretch", "left_semi") for c in (F.col("count") <= g.stretch, F.col("count") > g.stretch))
        found.append(small.select("stretch", "s", "t").groupBy("stretch").applyInPandas(_tarjan, "id long, comp long"))
        if large.isEmpty():
            break
        done, live = _coloured(large.drop("stretch"))
        found.append(done)
    if not found:
        return single
    union = found[0]
    for more in found[1:]:
        union = union.union(more)
    return settled(single.select("id").join(union, "id", "left").select("id", F.coalesce("comp", "id").alias("comp")), "components")


@dataclass
class Condensed:
    """nodes (incident_id, id, block, members, last, impact, first_at, event_id) and edges (s, sb, t, tb, w)."""

    nodes: DataFrame
    edges: DataFrame
    comp: DataFrame


def condense(g: Big, weight: Column | None = None) -> Condensed:
    comp = components(g)
    v = g.vertices.join(comp, "id").withColumn("weight", F.lit(0.0) if weight is None else weight)
    nodes = v.groupBy("incident_id", F.col("comp").alias("id")).agg(
        F.count("*").alias("members"),
        F.max("id").alias("last"),
        F.max("weight").alias("impact"),
        *(F.min_by(c, "id").alias(n) for c, n in (("block", "block"), ("timestamp", "first_at"), ("event_id", "event_id"))),
    )
    nodes = settled(nodes, "nodes")
    s, t = (comp.join(nodes.select(F.col("id").alias("comp"), F.col("block").alias(f"{c}b")), "comp").select(F.col("id").alias(c), F.col("comp").alias(f"{c}c"), f"{c}b") for c in "st")
    e = g.edges.select("s", "t").join(s, "s").join(t, "t").filter("sc <> tc").select(F.col("sc").alias("s"), "sb", F.col("tc").alias("t"), "tb").distinct()
    return Condensed(nodes, settled(e.withColumn("w", F.lit(1).cast("long")), "condensed"), comp)


def counted(c: Condensed, roots: DataFrame) -> DataFrame:
    """(incident_id, id, below): how many events each of ``roots(incident_id, id, bit)`` leads to outside
    itself; at most ROOTS of an incident, each with a bit of its own from 0."""
    seeds = c.nodes.select("id", "block").join(roots.select("id", "bit"), "id", "left").select("id", "block", F.expr("CASE WHEN bit IS NULL THEN 0L ELSE shiftleft(1L, bit) END").alias("v0"))
    reached = spread(seeds, c.edges, "or").join(c.nodes.select("incident_id", "id", "members"), "id")
    sums = reached.filter("v0 <> 0").groupBy("incident_id").agg(*(F.sum(F.when(F.expr(f"getbit(v0, {i}) = 1"), F.col("members"))).alias(f"n{i}") for i in range(ROOTS)))
    sums = sums.select("incident_id", F.posexplode(F.array(*(f"n{i}" for i in range(ROOTS)))).alias("bit", "below")).filter("below is not null")
    return roots.join(sums, ["incident_id", "bit"]).join(c.nodes.select("id", "members"), "id").select("incident_id", "id", (F.col("below") - F.col("members")).alias("below"))


def estimated(c: Condensed, draws: int = DRAWS) -> DataFrame:
    """(incident_id, id, below): estimates for all components at once. Each draws exponential numbers, as often
    as it has events; the smallest that a component reaches tells how many it reaches. The standard error is
    1 / sqrt(draws - 2) of the count."""
    first = [(-F.log(1 - (F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1 << 52)) / float(1 << 52))) / F.col("members")).alias(f"v{i}") for i in range(draws)]
    least = spread(c.nodes.select("id", "block", *first), _turned(c.edges), "min")
    total = sum((F.col(f"v{i}") for i in range(1, draws)), F.col("v0"))
    return least.join(c.nodes.select("incident_id", "id", "members"), "id").select("incident_id", "id", F.greatest((draws - 1) / total - F.col("members"), F.lit(0.0)).alias("below"))


def _top(rows: DataFrame, order: list[Column], n: int, name: str) -> DataFrame:
    """The first ``n`` rows of each incident, with their rank ``name`` from 0; first within shares of it."""
    share = Window.partitionBy("incident_id", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy(*order)
    rows = rows.withColumn(name, F.row_number().over(share)).filter(F.col(name) <= n)
    return rows.withColumn(name, F.row_number().over(Window.partitionBy("incident_id").orderBy(*order)) - 1).filter(F.col(name) < n)


def root_candidates(g: Big, weight: Column, score, top: int) -> DataFrame:
    """(incident_id, rank, event_id, score, reach, earliness, impact, members).

    Roots are counted exactly, ROOTS of an incident a pass, those that can score most first: what a root
    reaches lies between the first and the last position it reaches. An incident is done when the next
    root can't come among its ``top``. ``score(part, early, impact)`` gives a column.
    """
    c = condense(g, weight)
    span = g.vertices.groupBy("incident_id").agg(F.count("*").alias("n"), F.min("timestamp").alias("low"), F.max("timestamp").alias("high"))
    # the incidents' own numbers: a row each
    roots = c.nodes.join(c.edges.select(F.col("t").alias("id")), "id", "left_anti").join(span, "incident_id")
    bounds = spread(c.nodes.select("id", "block", F.col("last").alias("v0"), (-F.col("id")).alias("v1")), _turned(c.edges), "max")
    seconds = lambda a, b: (F.unix_micros(a) - F.unix_micros(b)) / 1e6
    digits = lambda x: F.round(x * 1e4) / 1e4  # as the kernel's
    early = 1 - seconds("first_at", "low") / F.greatest(seconds("high", "low"), F.lit(1e-9))
    roots = roots.join(bounds.select("id", F.col("v0").alias("b0"), F.col("v1").alias("b1")), "id")
    roots = roots.withColumn("early", early).withColumn("most", score(F.least(F.lit(1.0), (F.col("b0") + F.col("b1") + 1) / F.col("n")), F.col("early"), F.col("impact")) + 1e-4)
    left, done = settled(roots.select("incident_id", "id", "event_id", "members", "n", "early", "impact", "most"), "roots"), None
    while True:
        batch = settled(_top(left, [F.desc("most"), F.asc("id")], ROOTS, "bit"), "batch")
        if batch.isEmpty():
            break
        below = counted(c, batch.select("incident_id", "id", "bit"))
        exact = batch.join(below.select("id", "below"), "id").withColumn("part", (F.col("below") + F.col("members")) / F.col("n"))
        exact = exact.withColumn("total", digits(score(F.col("part"), F.col("early"), F.col("impact"))))
        seen = exact if done is None else done.unionByName(exact, allowMissingColumns=True)
        done = settled(_top(seen, [F.desc("total"), F.asc("id")], top, "rank").select("incident_id", "id", "event_id", "members", "early", "impact", "part", "total", "rank"), "candidates")
        last = done.filter(F.col("rank") == top - 1).select("incident_id", F.col("total").alias("bar"))
        rest = left.join(batch.select("id"), "id", "left_anti").join(last, "incident_id", "left").filter(F.col("bar").isNull() | (F.col("most") >= F.col("bar"))).drop("bar")
        old, left = left, settled(rest, "roots")
        discard(old)
    if done is None:
        done = batch.select("incident_id", "id", "event_id", "members", "early", "impact", F.lit(0.0).alias("part"), F.lit(0.0).alias("total"), F.col("bit").alias("rank"))
    return done.select("incident_id", (F.col("rank") + 1).cast("int").alias("rank"), "event_id", F.col("total").alias("score"), digits(F.col("part")).alias("reach"), digits(F.col("early")).alias("earliness"), "impact", "members")


def timelines(g: Big) -> DataFrame:
    """(incident_id, position, event_id): components by the latest position that must come before or with them,
    then by the steps since, then by their own; events of one by position."""
    c = condense(g)
    key = spread(c.nodes.select("id", "block", F.col("id").alias("v0")), c.edges, "max").select("id", "block", F.col("v0").alias("key"))
    s, t = (key.select(F.col("id").alias(x), F.col("key").alias(f"{x}k")) for x in "st")
    tied = c.edges.join(s, "s").join(t, "t").filter("sk = tk").select(*c.edges.columns)
    level = spread(key.select("id", "block", F.lit(0).cast("long").alias("v0")), tied, "max", step=True).select("id", F.col("v0").alias("level"))
    order = key.join(level, "id").select(F.col("id").alias("comp"), "key", "level")
    rows = g.vertices.select("incident_id", "event_id", "id").join(c.comp, "id").join(order, "comp").withColumn("weight", F.lit(1))
    placed = settled(_in_order(rows, ["incident_id", "key", "level", "comp", "id"], 5 * g.block).select("incident_id", "place", "event_id"), "timeline")
    first = placed.groupBy("incident_id").agg(F.min("place").alias("first"))
    return placed.join(first, "incident_id").select("incident_id", (F.col("place") - F.col("first")).alias("position"), "event_id")


def strongest_chains(g: Big, ends: DataFrame) -> DataFrame:
    """(incident_id, source, sink, path, strength) of ``ends(incident_id, source, sink)``, CHAINS of an incident
    a pass. Of equally strong chains the shortest counts, then the one whose events come first, from its end."""
    asked = ends.distinct().withColumn("k", F.row_number().over(Window.partitionBy("incident_id").orderBy("source", "sink")) - 1)
    where = lambda name: g.vertices.select("incident_id", F.col("event_id").alias(name), F.col("id").alias(f"{name}_id"))
    asked = settled(asked.join(where("source"), ["incident_id", "source"], "left").join(where("sink"), ["incident_id", "sink"], "left"), "asked")
    passes, out = (asked.agg(F.max("k")).first()[0] or 0) // CHAINS + 1, None
    for number_ in range(passes):
        now = asked.filter(F.floor(F.col("k") / CHAINS) == number_).withColumn("slot", (F.col("k") % CHAINS).cast("long"))
        starts = now.filter("source_id is not null and sink_id is not null").groupBy(F.col("source_id").alias("id")).agg(*(F.max(F.when(F.col("slot") == i, 0.0)).alias(f"s{i}") for i in range(CHAINS)))
        values = g.vertices.select("id", "block").join(starts, "id", "left").select("id", "block", *(F.coalesce(f"s{i}", F.lit(math.inf)).alias(f"v{i}") for i in range(CHAINS)))
        cost = spread(values, g.edges, "min", step=True)
        # copies of the graph, one a slot, with the edges on strongest chains alone
        s, t = (cost.select(F.col("id").alias(x), F.array(*(f"v{i}" for i in range(CHAINS))).alias(f"{x}v")) for x in "st")
        tight = g.edges.join(s, "s").join(t, "t").select("s", "sb", "t", "tb", "w", F.posexplode(F.arrays_zip("sv", "tv")).alias("slot", "c")).filter(f"c.tv < double('infinity') AND c.sv + w = c.tv")
        copy = lambda x: (F.col(x) * CHAINS + F.col("slot")).alias(x)
        tight = settled(tight.select(copy("s"), "sb", copy("t"), "tb", F.lit(1).cast("long").alias("w")), "tight")
        nodes = cost.select("id", "block", F.posexplode(F.array(*(f"v{i}" for i in range(CHAINS)))).alias("slot", "cost")).filter("cost < double('infinity')").select(copy("id"), "block", "cost")
        begin = now.select((F.col("source_id") * CHAINS + F.col("slot")).alias("id"), F.lit(0).cast("long").alias("zero"))
        hops = spread(nodes.join(begin, "id", "left").select("id", "block", F.coalesce("zero", F.lit(FAR // 2)).alias("v0")), tight, "min", step=True).select("id", "block", F.col("v0").alias("hops"))
        s, t = (hops.select(F.col("id").alias(x), F.col("hops").alias(f"{x}h")) for x in "st")
        before = tight.join(s, "s").join(t, "t").filter("sh + 1 = th").groupBy("t", "tb").agg(F.min(F.struct("s", "sb")).alias("p")).select("t", "tb", "p.s", "p.sb", F.lit(0).cast("long").alias("w"))
        finish = now.select((F.col("sink_id") * CHAINS + F.col("slot")).alias("id"), F.lit(1).cast("long").alias("one"))
        on = spread(hops.join(finish, "id", "left").select("id", "block", F.coalesce("one", F.lit(0)).alias("v0")), _turned(before), "max").filter("v0 = 1").select("id")
        steps = hops.join(on, "id").join(nodes.select("id", "cost"), "id").select(F.expr(f"id div {CHAINS}").alias("v"), (F.col("id") % CHAINS).alias("slot"), "hops", "cost")
        steps = steps.join(g.vertices.select(F.col("id").alias("v"), "incident_id", "event_id"), "v")
        paths = steps.groupBy("incident_id", "slot").agg(F.array_sort(F.collect_list(F.struct("hops", "event_id"))).alias("p"), F.max("cost").alias("cost"))
        rows = now.join(paths, ["incident_id", "slot"], "left")
        rows = rows.select("incident_id", "source", "sink", F.coalesce(F.col("p.event_id"), F.array().cast("array<string>")).alias("path"), F.when(F.col("p").isNull(), 0.0).otherwise(F.exp(-F.col("cost"))).alias("strength"))
        out = rows if out is None else out.union(rows)
    return out
