"""Filters, point reads and aggregates over events: the interactive query surface."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrelog.functions.text import severity_name

ORDER = ["timestamp", "ord"]


def contains(start: Column, end: Column, at: Column) -> Column:
    """Closed windows: both ends are inside."""
    return at.between(start, end)


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start <= b_end) & (b_start <= a_end)


def window(events: DataFrame, start: datetime, end: datetime, service: str | None = None, min_severity: int = 10, limit: int | None = None) -> DataFrame:
    """Events of a closed time range in time order; filters reach the scan, and where the events have a date the
    range's dates choose the partitions that are read."""
    if "event_date" in events.columns:
        events = events.filter(F.col("event_date").between(*(F.to_date(F.lit(t).cast("timestamp")) for t in (start, end))))
    out = events.filter(F.col("timestamp").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")) & (F.col("severity") >= min_severity))
    if service is not None:
        out = out.filter(F.col("service") == service)
    return out.orderBy(*ORDER).limit(limit) if limit is not None else out


def search(events: DataFrame, text: str, only_errors: bool = False, limit: int | None = None) -> DataFrame:
    """Events whose message holds ``text`` in any case."""
    out = events.filter(F.lower("message").contains(text.lower()))
    if only_errors:
        out = out.filter("severity >= 40")
    return out.orderBy(*ORDER).limit(limit) if limit is not None else out


def similar_to(events: DataFrame, event_id) -> DataFrame:
    """Events with the fingerprint of one event, itself too; none for an unknown id."""
    one = events.filter(F.col("event_id") == event_id).select("fingerprint").limit(1)
    return events.join(F.broadcast(one), "fingerprint", "left_semi")  # one row


def interesting(events: DataFrame, clusters: DataFrame) -> DataFrame:
    """Warnings and worse, and whatever stands for an anomaly."""
    named = clusters.select(F.explode("representative_events").alias("event_id")).distinct().withColumn("_named", F.lit(True))
    out = events.join(named, "event_id", "left").filter((F.col("severity") >= 30) | F.col("_named"))
    return out.select(*events.columns)


def digest(events: DataFrame) -> DataFrame:
    """What a reader needs of an event; a null trace id is left out of the JSON."""
    fields = [
        F.col("event_id").cast("string").alias("id"), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), "service",
        severity_name(F.col("severity")).alias("severity"), "kind", F.substring("message", 1, 200).alias("message"), "trace_id",
    ]
    return events.select(*fields, F.to_json(F.struct(*fields)).alias("json"))


def error_rate(events: DataFrame, seconds: int = 10, start=None, end=None, service: str | None = None) -> DataFrame:
    """Events and errors by service and epoch-aligned bucket; empty buckets have no row."""
    if start is not None:
        events = events.filter(F.col("timestamp") >= F.lit(start).cast("timestamp"))
    if end is not None:
        events = events.filter(F.col("timestamp") <= F.lit(end).cast("timestamp"))
    if service is not None:
        events = events.filter(F.col("service") == service)
    bucket = (F.floor(F.unix_micros("timestamp") / (seconds * 1_000_000)) * seconds).alias("bucket")
    out = events.groupBy("service", bucket).agg(F.count("*").alias("total"), F.count_if(F.col("severity") >= 40).alias("errors"))
    return out.withColumn("ratio", F.round(F.col("errors") / F.col("total"), 4))


def pool_pressure(events: DataFrame, start=None, end=None) -> DataFrame:
    """By service: how often the pool was spoken of, from when to when, and the first message."""
    events = events.filter("kind = 'db_pool'")
    if start is not None:
        events = events.filter(F.col("timestamp").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    first = F.min(F.struct("timestamp", "ord", F.substring("message", 1, 200).alias("m")))
    return events.groupBy("service").agg(F.count("*").alias("n"), F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at"), first["m"].alias("sample"))


def signatures(events: DataFrame) -> DataFrame:
    """The dimension of templates: one row per fingerprint, with its first sight."""
    return events.groupBy("fingerprint").agg(F.min("template").alias("template"), F.min("timestamp").alias("first_seen"), F.count("*").alias("n"))


def with_signatures(events: DataFrame, dimension: DataFrame) -> DataFrame:
    return events.join(dimension, "fingerprint")


def latest(df: DataFrame, keys: list[str], *newest: Column) -> DataFrame:
    """The newest row of each key."""
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*newest)))
    return ranked.filter("_r = 1").drop("_r")


def dependencies(deps: DataFrame) -> DataFrame:
    """By service: what it depends on and what depends on it, sorted."""
    out = deps.select(F.col("service").alias("name"), F.col("dependency").alias("on"), F.lit(None).cast("string").alias("by"))
    back = deps.select(F.col("dependency").alias("name"), F.lit(None).cast("string").alias("on"), F.col("service").alias("by"))
    return out.union(back).groupBy("name").agg(F.array_sort(F.collect_set("on")).alias("depends_on"), F.array_sort(F.collect_set("by")).alias("depended_on_by"))


def anomalies(clusters: DataFrame, kind: str | None = None, most: int = 5) -> DataFrame:
    out = clusters if kind is None else clusters.filter(F.col("kind") == kind)
    return out.withColumn("representative_events", F.slice("representative_events", 1, most))
