"""Detectors over streams: the same folds as in batch, with their baselines as keyed state.

A window is judged when the watermark passes its end. Rows that come later than the watermark are
dropped by Spark (batch keeps them); the delay should be one window at least. A key that is silent for
``Settings.idle`` windows loses its state, so state doesn't grow with every key ever seen; its baseline
then begins anew, where batch would go on with the old one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from datetime import datetime
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kestrelog.operators.detect import CLUSTER_COLUMNS, Baseline, Settings, fold_errors, fold_frequency, fold_retries
from kestrelog.schema import CLUSTER

STATE = "mean double, variance double, samples long, last long, idx array<long>, n array<long>, errors array<long>, reps array<array<string>>, template string"


def _stream(events: DataFrame, keys: list[str], fold: Callable, kind: str, detector: int, s: Settings, delay: str, errors_only: bool) -> DataFrame:
    rows = events.withWatermark("timestamp", delay).select(*keys, "timestamp", "ord", F.col("event_id").cast("string").alias("event_id"), "severity", "template")

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mean, variance, samples, last, idx, n, errors, reps, template = state.get if state.exists else (0.0, 0.0, 0, None, [], [], [], [], None)
        open_windows = {i: [c, e, list(r)] for i, c, e, r in zip(idx, n, errors, reps)}
        if not state.hasTimedOut:
            for pdf in frames:
                for r in pdf.sort_values(["timestamp", "ord"]).itertuples():
                    w = open_windows.setdefault(int(r.timestamp.timestamp() // s.seconds), [0, 0, []])
                    error = r.severity >= 40
                    w[0] += 1
                    w[1] += int(error)
                    if len(w[2]) < s.reps and (error or not errors_only):
                        w[2].append(r.event_id)
                    template = r.template if template is None else min(template, r.template)
        mark = state.getCurrentWatermarkMs()
        due = sorted(i for i in open_windows if (i + 1) * s.seconds * 1000 <= mark)
        base = Baseline(s.alpha, mean, variance, samples)
        out = []
        for i in due:  # in order: the baseline depends on it
            c, e, r = open_windows.pop(i)
            one = SimpleNamespace(itertuples=lambda i=i, c=c, e=e, r=r: iter([SimpleNamespace(idx=i, n=c, errors=e, reps=r, template=template)]))
            for _, count, confidence, attributes, found in fold(one, s, base, last):
                start = pd.Timestamp(i * s.seconds, unit="s", tz="UTC")
                out.append((kind, key[0], key[-1], start, start + pd.Timedelta(seconds=s.seconds), int(count), float(confidence), list(found), attributes, detector))
            last = i
        rest = sorted(open_windows)
        if state.hasTimedOut and not rest and not due:  # silent for ``idle`` windows: as if never seen
            state.remove()
            yield pd.DataFrame([], columns=CLUSTER_COLUMNS)
            return
        state.update((base.mean, base.variance, base.samples, last, rest, [open_windows[i][0] for i in rest], [open_windows[i][1] for i in rest], [open_windows[i][2] for i in rest], template))
        ends = (rest[0] + 1) if rest else (last if last is not None else 0) + 1 + s.idle
        state.setTimeoutTimestamp(max(ends * s.seconds * 1000, mark + 1))
        yield pd.DataFrame(out, columns=CLUSTER_COLUMNS)

    return rows.groupBy(*keys).applyInPandasWithState(run, CLUSTER, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def frequency_spikes(events: DataFrame, s: Settings = Settings(), delay: str = "10 seconds") -> DataFrame:
    return _stream(events, ["service", "fingerprint"], fold_frequency, "frequency_spike", 0, s, delay, False)


def error_ratios(events: DataFrame, s: Settings = Settings(), delay: str = "10 seconds") -> DataFrame:
    return _stream(events, ["service"], fold_errors, "error_ratio", 2, s, delay, True)


def retry_storms(events: DataFrame, s: Settings = Settings(), delay: str = "10 seconds") -> DataFrame:
    return _stream(events.filter("kind = 'task_retry'"), ["service"], fold_retries, "retry_storm", 3, s, delay, False)


def new_signatures(events: DataFrame, learned_until: datetime, s: Settings = Settings(), delay: str = "10 seconds") -> DataFrame:
    """Templates first seen, at warning or worse, after ``learned_until`` (see :func:`learned_until`): a
    cluster a template, of what comes within one window of its first event. A template whose first event
    is early or mild is known and never reported. A template that is silent for ``Settings.idle`` windows is
    forgotten, and new when it comes again; batch holds a template new until a mild event."""
    rows = events.withWatermark("timestamp", delay).select("service", "fingerprint", "timestamp", "ord", F.col("event_id").cast("string").alias("event_id"), "severity", "template")
    cut, span = pd.Timestamp(learned_until).timestamp(), s.seconds

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, at, times, counts, rep_times, rep_ords, ids, template = state.get if state.exists else (False, 0.0, [], [], [], [], [], None)
        seen, reps = Counter(dict(zip(times, counts))), list(zip(rep_times, rep_ords, ids))
        first = min(seen, default=None)
        if state.hasTimedOut and known:
            state.remove()
            yield pd.DataFrame([], columns=CLUSTER_COLUMNS)
            return
        latest = at
        if not state.hasTimedOut:
            for pdf in frames:
                for r in pdf.sort_values(["timestamp", "ord"]).itertuples():
                    now = r.timestamp.timestamp()
                    latest = max(latest, now)
                    if known:
                        continue
                    if now <= cut or (r.severity < 30 and (first is None or now < first)):
                        known, first, reps = True, None, []
                        seen.clear()
                    elif r.severity >= 30:
                        first = now if first is None else min(first, now)
                        if now <= first + span:  # the window can only begin earlier: what is beyond it stays so
                            seen[now] += 1
                            reps.append((now, r.ord, r.event_id))
                        template = r.template
            if first is not None:
                seen = Counter({t: n for t, n in seen.items() if t <= first + span})
                reps = sorted(x for x in reps if x[0] <= first + span)[: s.reps]
        mark, out = state.getCurrentWatermarkMs(), []
        if not known and first is not None and (first + span) * 1000 <= mark:
            start, end = (pd.Timestamp(t, unit="s", tz="UTC") for t in (first, max(seen)))
            n = sum(seen.values())
            out.append(("new_signature", key[0], key[1], start, end, n, min(0.9, 0.7 + 0.02 * n), [x[2] for x in reps], {"template": template}, 1))
            known, first, reps = True, None, []
            seen.clear()
        state.update((known, latest, list(seen), list(seen.values()), [x[0] for x in reps], [x[1] for x in reps], [x[2] for x in reps], template))
        ends = latest + span * s.idle if known or first is None else first + span
        state.setTimeoutTimestamp(max(int(ends * 1000), mark + 1))
        yield pd.DataFrame(out, columns=CLUSTER_COLUMNS)

    return rows.groupBy("service", "fingerprint").applyInPandasWithState(run, CLUSTER, "known boolean, at double, times array<double>, counts array<long>, rep_times array<double>, rep_ords array<long>, ids array<string>, template string", "append", GroupStateTimeout.EventTimeTimeout)


def learned_until(events: DataFrame, learning: int = 500) -> datetime | None:
    """The time of the last of the first ``learning`` events of a batch: what a stream goes on from."""
    return events.select("timestamp").orderBy("timestamp").limit(learning).agg(F.max("timestamp").alias("t")).first().t


def error_rate(events: DataFrame, seconds: int = 10, delay: str = "10 seconds") -> DataFrame:
    """Events and errors by service and window, emitted once the watermark has passed a window."""
    out = events.withWatermark("timestamp", delay).groupBy("service", F.window("timestamp", f"{seconds} seconds").alias("w"))
    return out.agg(F.count("*").alias("total"), F.count_if(F.col("severity") >= 40).alias("errors")).select("service", F.col("w.start").alias("bucket"), "total", "errors")
