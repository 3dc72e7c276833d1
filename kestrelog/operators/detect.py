"""Four anomaly detectors over event-time windows, batch.

Events are first reduced to one row per key and window by Spark; only those rows meet the order-bound
part, an exponentially weighted baseline that is folded window by window for each key.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrelog.schema import CLUSTER

CLUSTER_COLUMNS = CLUSTER.fieldNames()


@dataclass
class Baseline:
    """Exponentially weighted mean and variance. The first full sample sets the mean; a sample of less
    weight moves it by a part."""

    alpha: float = 0.3
    mean: float = 0.0
    variance: float = 0.0
    samples: int = 0

    def add(self, value: float, weight: float = 1.0) -> None:
        if weight <= 0:
            return
        self.samples += 1
        if self.samples == 1 and weight >= 1:
            self.mean = float(value)
            return
        share = self.alpha * min(weight, 1.0)
        gap = value - self.mean
        step = share * gap
        self.mean += step
        self.variance = (1 - share) * (self.variance + gap * step)

    def z(self, value: float) -> float:
        """Standard deviations above the mean; a count varies at least by its root."""
        if self.samples == 0:
            return 0.0
        return (value - self.mean) / max(math.sqrt(self.variance), math.sqrt(max(self.mean, 1e-9)), 1e-9)


@dataclass(frozen=True)
class Settings:
    """Fixed values by default; all can be set."""

    seconds: int = 10
    alpha: float = 0.3
    reps: int = 10
    z: float = 3.0
    min_count: int = 10
    warmup: int = 3
    max_gap: int = 50
    learning: int = 500
    min_events: int = 20
    min_ratio: float = 0.10
    factor: float = 3.0
    min_retries: int = 15
    absolute: int = 50
    idle: int = 8640

    def but(self, **changes) -> Settings:
        return replace(self, **changes)


def buckets(events: DataFrame, keys: list[str], s: Settings, errors_only: bool = False) -> DataFrame:
    """(keys, idx, n, errors, reps, template): one row per key and window; reps are the first ids."""
    idx = F.floor(F.unix_micros("timestamp") / (s.seconds * 1_000_000)).alias("idx")
    rows = events.select(*keys, idx, "event_id", "timestamp", "ord", (F.col("severity") >= 40).alias("e"), F.col("template").alias("_t"))
    # numbering and grouping share one shuffle, by key and window
    order = Window.partitionBy(*keys, "idx", *(["e"] if errors_only else [])).orderBy("timestamp", "ord")
    rows = rows.withColumn("_r", F.row_number().over(order))
    pick = (F.col("_r") <= s.reps) & (F.col("e") if errors_only else F.lit(True))
    reps = F.array_sort(F.collect_list(F.when(pick, F.struct("_r", F.col("event_id").cast("string").alias("id")))))
    return rows.groupBy(*keys, "idx").agg(F.count("*").alias("n"), F.count_if("e").alias("errors"), F.transform(reps, lambda x: x["id"]).alias("reps"), F.min("_t").alias("template"))


def fold_frequency(rows: pd.DataFrame, s: Settings, state: Baseline | None = None, last: int | None = None):
    """Windows of one key in order: (idx, count, confidence, attributes, reps) where the count stands out."""
    base = state or Baseline(s.alpha)
    for r in rows.itertuples():
        if last is not None:
            for _ in range(min(max(r.idx - last - 1, 0), s.max_gap)):
                base.add(0.0)
        z = base.z(r.n)
        if base.samples >= s.warmup and r.n >= s.min_count and z >= s.z:
            yield r.idx, r.n, min(0.99, z / (z + 3)), {"observed": str(r.n), "baseline_mean": str(round(base.mean, 3)), "z_score": str(round(z, 2)), "template": r.template}, r.reps
        base.add(r.n)
        last = r.idx


def fold_errors(rows: pd.DataFrame, s: Settings, state: Baseline | None = None, last=None):
    base = state or Baseline(s.alpha)
    for r in rows.itertuples():
        ratio = r.errors / r.n
        if base.samples >= s.warmup and r.n >= s.min_events and ratio >= max(s.min_ratio, s.factor * base.mean):
            yield r.idx, r.errors, min(0.99, (ratio - base.mean) / max(ratio, 1e-9)), {"error_ratio": str(round(ratio, 4)), "baseline_ratio": str(round(base.mean, 4)), "errors": str(r.errors), "total": str(r.n)}, r.reps
        base.add(ratio, r.n / s.min_events)


def fold_retries(rows: pd.DataFrame, s: Settings, state: Baseline | None = None, last=None):
    base = state or Baseline(s.alpha)
    for r in rows.itertuples():
        usual = max(base.mean, 1.0)
        if r.n >= s.min_retries and (r.n >= s.factor * usual or r.n >= s.absolute):
            surge = r.n / usual
            yield r.idx, r.n, min(0.99, surge / (surge + 3)), {"retries": str(r.n), "baseline_mean": str(round(base.mean, 3))}, r.reps
        base.add(r.n)


def _folded(rows: DataFrame, keys: list[str], fold: Callable, kind: str, detector: int, s: Settings) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        service = pdf["service"].iloc[0]
        key = pdf[keys[-1]].iloc[0]
        out = []
        for idx, count, confidence, attributes, reps in fold(pdf, s):
            start = pd.Timestamp(int(idx) * s.seconds, unit="s", tz="UTC")
            out.append((kind, service, key, start, start + pd.Timedelta(seconds=s.seconds), int(count), float(confidence), list(reps), attributes, detector))
        return pd.DataFrame(out, columns=CLUSTER_COLUMNS)

    return rows.groupBy(*keys).applyInPandas(run, CLUSTER)


def frequency_spikes(events: DataFrame, s: Settings = Settings()) -> DataFrame:
    keys = ["service", "fingerprint"]
    return _folded(buckets(events, keys, s), keys, fold_frequency, "frequency_spike", 0, s)


def new_signatures(events: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Templates first seen, at warning or worse, after the first ``learning`` events. A template is
    known from its first event that is early or mild; what stands before that is the cluster."""
    at = F.struct("timestamp", "ord")
    early = events.select("timestamp", "ord").orderBy("timestamp", "ord").limit(s.learning).agg(F.max(at).alias("at")).first().at
    learned = F.lit(False) if early is None else (F.col("timestamp") < F.lit(early.timestamp)) | ((F.col("timestamp") == F.lit(early.timestamp)) & (F.col("ord") <= early.ord))
    keys = ["service", "fingerprint"]
    rows = events.select(*keys, "timestamp", "ord", "severity", "event_id", "template", learned.alias("early"))
    known = rows.filter(F.col("early") | (F.col("severity") < 30)).groupBy(*keys).agg(F.min(at).alias("known_at"))
    rows = rows.filter(~F.col("early") & (F.col("severity") >= 30)).join(known, keys, "left")
    rows = rows.filter(F.col("known_at").isNull() | (at < F.col("known_at")))
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("timestamp", "ord")))
    reps = F.transform(F.array_sort(F.collect_list(F.when(F.col("_r") <= s.reps, F.struct("_r", F.col("event_id").cast("string").alias("id"))))), lambda x: x["id"])
    out = rows.groupBy(*keys).agg(F.min("timestamp").alias("window_start"), F.max("timestamp").alias("window_end"), F.count("*").alias("event_count"), reps.alias("representative_events"), F.min("template").alias("t"))
    return out.select(
        F.lit("new_signature").alias("kind"), "service", F.col("fingerprint").alias("key"), "window_start", "window_end", "event_count",
        F.least(F.lit(0.9), 0.7 + 0.02 * F.col("event_count")).cast("double").alias("confidence"), "representative_events", F.create_map(F.lit("template"), F.col("t")).alias("attributes"), F.lit(1).alias("detector"),
    )


def error_ratios(events: DataFrame, s: Settings = Settings()) -> DataFrame:
    return _folded(buckets(events, ["service"], s, errors_only=True), ["service"], fold_errors, "error_ratio", 2, s)


def retry_storms(events: DataFrame, s: Settings = Settings()) -> DataFrame:
    return _folded(buckets(events.filter("kind = 'task_retry'"), ["service"], s), ["service"], fold_retries, "retry_storm", 3, s)


DETECTORS = (frequency_spikes, new_signatures, error_ratios, retry_storms)


def detect(events: DataFrame, s: Settings = Settings(), detectors=DETECTORS) -> DataFrame:
    """Clusters of all detectors; in order of (window_start, detector, service, key) when ordered."""
    return reduce(DataFrame.unionByName, [d(events, s) for d in detectors])


CLUSTER_ORDER = ["window_start", "detector", "service", "key"]


def boosts(clusters: DataFrame, keep: str = "last") -> DataFrame:
    """event_id -> confidence of the last cluster, in order, that it stands for (or the highest)."""
    rows = clusters.select(F.explode("representative_events").alias("event_id"), "confidence", F.struct(*CLUSTER_ORDER).alias("at"))
    pick = F.max_by("confidence", "at") if keep == "last" else F.max("confidence")
    return rows.groupBy("event_id").agg(pick.alias("boost"))
