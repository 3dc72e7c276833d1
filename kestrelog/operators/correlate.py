"""Which events may have led to which: blocked candidate pairs and their weighted scores."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrelog.functions.text import seconds_between, tokens

HORIZON, CAP, LEAST = 60, 50, 0.35

#: How likely an event of one kind follows one of another.
CASCADES = {
    ("external_call", "exception"): 0.8, ("external_call", "task_retry"): 0.7, ("exception", "db_pool"): 0.9, ("exception", "task_retry"): 0.8, ("exception", "exception"): 0.5,
    ("db_query", "db_pool"): 0.9, ("db_pool", "db_query"): 0.8, ("db_pool", "db_pool"): 0.7, ("db_pool", "task_retry"): 0.9, ("db_pool", "http_request"): 0.7,
    ("task_retry", "db_pool"): 0.7, ("task_retry", "task_retry"): 0.6, ("http_request", "exception"): 0.5,
}


def related(deps: DataFrame) -> DataFrame:
    """(service, other) for each dependency, in both directions, without a service and itself."""
    pairs = deps.select("service", F.col("dependency").alias("other")).union(deps.select(F.col("dependency").alias("service"), F.col("service").alias("other")))
    return pairs.filter("service <> other").distinct()


def candidates(events: DataFrame, deps: DataFrame, horizon: int = HORIZON, cap: int = CAP) -> DataFrame:
    """(src, tgt): for each event its next ``cap`` events within ``horizon`` seconds that share its trace,
    request, fingerprint or service, or come from a related service.

    All rules keep the same order, so the cap applies to each rule first: events of a key and time bucket
    are numbered, and an event gathers the next ``cap`` of its own bucket in a window frame, and the first
    ones of the next bucket, which are gathered once a bucket. Only pairs that stand are ever rows, no event
    is compared with all others of its key, and a busy key is split by time.
    """
    e = events.select("event_id", "timestamp", "ord", "trace_id", "request_id", "fingerprint", "service", F.floor(F.unix_micros("timestamp") / (horizon * 1_000_000)).alias("bucket"))
    own = F.array(*[F.struct(F.lit(i).alias("rule"), F.col(c).alias("key")) for i, c in enumerate(("trace_id", "request_id", "fingerprint", "service"))])
    base = ["event_id", "timestamp", "ord", "bucket"]
    keyed = e.select(*base, F.explode(own).alias("k")).select(*base, "k.rule", "k.key", F.lit(True).alias("target")).filter("key is not null")
    services = e.select(*base, F.lit(4).alias("rule"), F.col("service").alias("key"), F.lit(True).alias("target"))
    # a source that looks into a related service's events stands among them, uncounted
    lookers = e.join(related(deps), "service").select(*base, F.lit(4).alias("rule"), F.col("other").alias("key"), F.lit(False).alias("target"))
    place = Window.partitionBy("rule", "key", "bucket")
    line = place.orderBy("timestamp", "ord").rowsBetween(Window.unboundedPreceding, 0)
    rows = keyed.union(services).union(lookers).withColumn("n", F.sum(F.col("target").cast("long")).over(line))
    event = F.struct(F.col("event_id").alias("tgt"), F.col("timestamp").alias("tgt_at"), F.col("ord").alias("tgt_ord"))
    rows = rows.withColumn("here", F.collect_list(F.when(F.col("target"), event)).over(place.orderBy("n").rangeBetween(1, cap)))
    first = rows.filter(F.col("target") & (F.col("n") <= cap)).groupBy("rule", "key", (F.col("bucket") - 1).alias("bucket")).agg(F.collect_list(event).alias("there"))
    sources = rows.filter("rule < 4 or not target").join(first, ["rule", "key", "bucket"], "left")
    micros = F.unix_micros("timestamp") + horizon * 1_000_000
    later = lambda x: (x["tgt_at"] > F.col("timestamp")) | ((x["tgt_at"] == F.col("timestamp")) & (x["tgt_ord"] > F.col("ord")))
    near = F.filter(F.concat("here", F.coalesce("there", F.array().cast(first.schema["there"].dataType))), lambda x: later(x) & (F.unix_micros(x["tgt_at"]) <= micros))
    pairs = sources.select(F.col("event_id").alias("src"), F.explode(near).alias("t")).select("src", "t.*")
    pairs = pairs.groupBy("src", "tgt").agg(F.first("tgt_at").alias("tgt_at"), F.first("tgt_ord").alias("tgt_ord"))
    pairs = pairs.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy("tgt_at", "tgt_ord")))
    return pairs.filter(F.col("r") <= cap).select("src", "tgt")


@dataclass(frozen=True)
class Strategy:
    """A named, weighted score of a pair: a column over the structs s (source) and t (target)."""

    name: str
    weight: float
    score: Callable[[], Column]


def temporal(horizon: int = HORIZON) -> Callable[[], Column]:
    gap = lambda: seconds_between(F.col("t.timestamp"), F.col("s.timestamp"))
    return lambda: F.when((gap() < 0) | (gap() > horizon), 0.0).otherwise(F.exp(-3 * gap() / horizon))


def linkage() -> Column:
    return F.coalesce(F.when(F.col("s.trace_id") == F.col("t.trace_id"), 1.0), F.when(F.col("s.request_id") == F.col("t.request_id"), 0.6), F.lit(0.0))


def dependency() -> Column:
    return F.when(F.col("s.service") == F.col("t.service"), 0.8).when(F.col("t_on_s"), 1.0).when(F.col("s_on_t"), 0.6).otherwise(0.0)


def propagation() -> Column:
    table = F.create_map(*[F.lit(x) for (a, b), v in CASCADES.items() for x in (f"{a}>{b}", v)])
    return F.when((F.col("s.severity") >= 30) & (F.col("t.severity") >= 30), F.coalesce(table[F.concat_ws(">", "s.kind", "t.kind")], F.lit(0.0))).otherwise(0.0)


STRATEGIES = (
    Strategy("temporal_proximity", 0.30, temporal()),
    Strategy("trace_linkage", 0.25, linkage),
    Strategy("service_dependency", 0.25, dependency),
    Strategy("semantic_similarity", 0.20, lambda: F.col("similarity")),
    Strategy("error_propagation", 0.15, propagation),
)


def similarity(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """(a, b, similarity) of distinct fingerprint pairs: Jaccard of their templates' words, 1 if equal.
    Templates are compared once, however many events carry them."""
    words = signatures.select("fingerprint", tokens(F.col("template")).alias("w"))
    a, b = words.select(F.col("fingerprint").alias("a"), F.col("w").alias("wa")), words.select(F.col("fingerprint").alias("b"), F.col("w").alias("wb"))
    both = F.size(F.array_intersect("wa", "wb"))
    score = F.when(F.col("a") == F.col("b"), 1.0).when((F.size("wa") == 0) | (F.size("wb") == 0), 0.0).otherwise(both / F.size(F.array_union("wa", "wb")))
    return pairs.join(a, "a").join(b, "b").select("a", "b", score.alias("similarity"))


def score(pairs: DataFrame, events: DataFrame, deps: DataFrame, strategies=STRATEGIES, least: float = LEAST) -> DataFrame:
    """Edges (source_event, target_event, composite_score, strategy_scores) of at least ``least``."""
    if not strategies or sum(s.weight for s in strategies) <= 0:
        raise ValueError("no strategy with a weight")
    fields = ["event_id", "timestamp", "service", "severity", "kind", "fingerprint", "trace_id", "request_id"]
    s = events.select(F.col("event_id").alias("src"), F.struct(*fields).alias("s"))
    t = events.select(F.col("event_id").alias("tgt"), F.struct(*fields).alias("t"))
    rows = pairs.join(s, "src").join(t, "tgt")
    signatures = events.groupBy("fingerprint").agg(F.min("template").alias("template"))
    known = similarity(rows.select(F.col("s.fingerprint").alias("a"), F.col("t.fingerprint").alias("b")).distinct(), signatures)
    rows = rows.join(known, (F.col("s.fingerprint") == F.col("a")) & (F.col("t.fingerprint") == F.col("b"))).drop("a", "b")
    on = deps.select("service", "dependency").distinct()
    on_a, on_b = on.select(F.col("service").alias("a1"), F.col("dependency").alias("a2"), F.lit(True).alias("t_on_s")), on.select(F.col("service").alias("b1"), F.col("dependency").alias("b2"), F.lit(True).alias("s_on_t"))
    rows = rows.join(on_a, (F.col("t.service") == F.col("a1")) & (F.col("s.service") == F.col("a2")), "left")
    rows = rows.join(on_b, (F.col("s.service") == F.col("b1")) & (F.col("t.service") == F.col("b2")), "left")
    rows = rows.select("src", "tgt", *[x.score().cast("double").alias(x.name) for x in strategies])
    total = reduce(lambda a, b: a + b, [F.col(x.name) * x.weight for x in strategies]) / sum(x.weight for x in strategies)
    rows = rows.withColumn("composite", total).filter(F.col("composite") >= least)
    return rows.select(F.col("src").alias("source_event"), F.col("tgt").alias("target_event"), F.round("composite", 4).alias("composite_score"), F.struct(*[F.round(x.name, 4).alias(x.name) for x in strategies]).alias("strategy_scores"))


def correlate(events: DataFrame, deps: DataFrame, horizon: int = HORIZON, cap: int = CAP, strategies=STRATEGIES, least: float = LEAST) -> DataFrame:
    return score(candidates(events, deps, horizon, cap), events, deps, strategies, least)
