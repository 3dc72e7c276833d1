"""Appending parquet tables. Updates are rows too: the newest row of a key is its state.

What belongs together in several tables carries the name of one commit, and the row that makes it valid is
written last. Readers take rows of commits that have that row: what a writer left behind when it died is never
seen, and its second run begins a commit of its own.
"""

from __future__ import annotations

import json
import uuid
import zlib
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelog.operators.query import latest, signatures
from kestrelog.schema import STATUSES


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def missing(new: DataFrame, spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The rows of ``new`` whose key the table doesn't have, one a key."""
    new = new.dropDuplicates(keys)
    return new.join(spark.read.parquet(path).select(*keys), keys, "left_anti") if exists(spark, path) else new


def append_missing(new: DataFrame, path: str, keys: list[str]) -> None:
    """Insert if absent: a second run with the same rows adds nothing."""
    missing(new, new.sparkSession, path, keys).write.mode("append").parquet(path)


def _write(events: DataFrame, root: str, batch: str, mode: str) -> None:
    rows = events.drop("template").withColumn("event_date", F.to_date("timestamp")).withColumn("batch", F.lit(batch))
    out = rows.sortWithinPartitions("service", "timestamp").write.mode(mode).option("partitionOverwriteMode", "dynamic")
    out.partitionBy("event_date", "batch").parquet(f"{root}/log_events")


def _unwritten(events: DataFrame, root: str, batch: str) -> DataFrame:
    """Events, one an id, that no other batch of the table has. Only the dates at hand are read again."""
    spark, path, rows = events.sparkSession, f"{root}/log_events", events.dropDuplicates(["event_id"])
    if not exists(spark, path):
        return rows
    old = spark.read.parquet(path).filter(F.col("batch") != batch).select("event_date", "event_id")
    return rows.withColumn("event_date", F.to_date("timestamp")).join(old, ["event_date", "event_id"], "left_anti").select(*events.columns)


def write_events(events: DataFrame, root: str) -> None:
    """Events by date, and their templates where they are new. Events that the table has, whoever wrote them,
    are left out: a second run with the same rows adds nothing."""
    append_missing(signatures(events).select("fingerprint", "template", "first_seen"), f"{root}/event_signatures", ["fingerprint"])
    _write(_unwritten(events, root, ""), root, "batch", "append")


def read_events(spark: SparkSession, root: str, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Events with their templates and their date; with ``start`` and ``end`` those of a closed range, of whose
    dates alone files are read."""
    rows = spark.read.option("basePath", f"{root}/log_events").parquet(f"{root}/log_events").drop("batch")
    for at, after in ((start, True), (end, False)):
        if at is not None:
            at = F.lit(at).cast("timestamp")
            rows = rows.filter((F.col("event_date") >= F.to_date(at)) & (F.col("timestamp") >= at) if after else (F.col("event_date") <= F.to_date(at)) & (F.col("timestamp") <= at))
    # two writers may have added one template at a time
    known = spark.read.parquet(f"{root}/event_signatures").groupBy("fingerprint").agg(F.min_by("template", F.struct("first_seen", "template")).alias("template"))
    return rows.join(known, "fingerprint")


def register_sources(sources: DataFrame, root: str) -> None:
    append_missing(sources.select("source_id", "log_format", F.current_timestamp().alias("created_at")), f"{root}/log_sources", ["source_id"])


def append(df: DataFrame, root: str, table: str) -> None:
    df.write.mode("append").parquet(f"{root}/{table}")


INCIDENT = "incident_id string, status string, seq long, window_start timestamp, window_end timestamp, summary string, created_at timestamp, commit string"


def sources(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/log_sources").orderBy("created_at", "source_id")


def create_incident(spark: SparkSession, root: str, incident_id: str, start: datetime, end: datetime, summary: str | None = None, status: str = "detected") -> None:
    _state(spark, root, (incident_id, status, 0, start, end, summary, datetime.now(UTC), None))


def _state(spark: SparkSession, root: str, row: tuple) -> None:
    if row[1] not in STATUSES:
        raise ValueError(row[1])
    append(spark.createDataFrame([row], INCIDENT), root, "incidents")


def incident(spark: SparkSession, root: str, incident_id: str):
    """The newest state of an incident; a KeyError if there is none."""
    found = incidents(spark, root).filter(F.col("incident_id") == incident_id).collect() if exists(spark, f"{root}/incidents") else []
    if not found:
        raise KeyError(incident_id)
    return found[0]


def set_status(spark: SparkSession, root: str, incident_id: str, status: str, summary: str | None = None) -> None:
    """A new state of a known incident; one writer an incident."""
    old = incident(spark, root, incident_id)
    _state(spark, root, (incident_id, status, old.seq + 1, old.window_start, old.window_end, summary if summary is not None else old.summary, old.created_at, old.commit))


def attach_analysis(root: str, incident_id: str, clusters: DataFrame, edges: DataFrame, start: datetime, end: datetime, summary: str | None = None) -> None:
    """An analysis of a known incident: its clusters and edges, then, as their commit, the incident's window and
    summary."""
    spark = clusters.sparkSession
    old, commit = incident(spark, root, incident_id), uuid.uuid4().hex
    for name, rows in (("anomaly_clusters", clusters), ("causal_edges", edges)):
        append(rows.drop("incident_id").withColumn("incident_id", F.lit(incident_id)).withColumn("commit", F.lit(commit)), root, name)
    _state(spark, root, (incident_id, old.status, old.seq + 1, start, end, summary if summary is not None else old.summary, old.created_at, commit))


def _of_incident(spark: SparkSession, root: str, name: str, incident_id: str) -> DataFrame:
    rows = spark.read.parquet(f"{root}/{name}")
    return rows.filter((F.col("incident_id") == incident_id) & (F.col("commit") == F.lit(incident(spark, root, incident_id).commit))).drop("commit")


def edges_of(spark: SparkSession, root: str, incident_id: str) -> DataFrame:
    """The edges of an incident's newest analysis."""
    return _of_incident(spark, root, "causal_edges", incident_id)


def clusters_of(spark: SparkSession, root: str, incident_id: str) -> DataFrame:
    """The clusters of an incident's newest analysis."""
    return _of_incident(spark, root, "anomaly_clusters", incident_id)


def incidents(spark: SparkSession, root: str) -> DataFrame:
    return latest(spark.read.parquet(f"{root}/incidents"), ["incident_id"], F.desc("seq"))


def recent_incidents(spark: SparkSession, root: str, limit: int = 50) -> DataFrame:
    """The newest incidents, the latest first: a top-k report."""
    return incidents(spark, root).orderBy(F.desc("created_at"), "incident_id").limit(limit)


def persist_investigation(spark: SparkSession, root: str, investigation_id: str, incident_id: str, result: dict, audit: DataFrame) -> None:
    """An investigation's findings, tool calls and patch, and last, as their commit, the investigation itself."""
    incident(spark, root, incident_id)
    commit = uuid.uuid4().hex
    findings = [(investigation_id, i, x["agent"], json.dumps(x["finding"]), commit) for i, x in enumerate(result["findings"])]
    append(spark.createDataFrame(findings, "investigation_id string, position int, agent string, finding string, commit string"), root, "agent_findings")
    append(audit.withColumn("investigation_id", F.lit(investigation_id)).withColumn("commit", F.lit(commit)), root, "tool_executions")
    if result.get("patch") is not None:
        append(spark.createDataFrame([(investigation_id, json.dumps(result["patch"]), commit)], "investigation_id string, patch string, commit string"), root, "patch_proposals")
    row = (investigation_id, incident_id, result["status"], json.dumps(result["verdict"]), datetime.now(UTC), commit)
    append(spark.createDataFrame([row], "investigation_id string, incident_id string, status string, verdict string, created_at timestamp, commit string"), root, "investigations")


def parts_of(spark: SparkSession, root: str, investigation_id: str, name: str = "agent_findings") -> DataFrame:
    """What a committed investigation has in ``agent_findings``, ``tool_executions`` or ``patch_proposals``; the
    newest commit's, if it was stored twice."""
    rows = spark.read.parquet(f"{root}/{name}").filter(F.col("investigation_id") == investigation_id)
    done = latest(spark.read.parquet(f"{root}/investigations").filter(F.col("investigation_id") == investigation_id), ["investigation_id"], F.desc("created_at"), F.desc("commit"))
    return rows.join(done.select("commit"), "commit", "left_semi").drop("commit")


def latest_investigation(spark: SparkSession, root: str, incident_id: str) -> DataFrame:
    found = spark.read.parquet(f"{root}/investigations").filter(F.col("incident_id") == incident_id)
    return latest(found, ["incident_id"], F.desc("created_at"), F.desc("investigation_id"))


def remember_once(memory: DataFrame, root: str) -> DataFrame:
    """(incident_id, outcome) of rows stored, or duplicate and left as they are."""
    path = f"{root}/incident_memory"
    new = missing(memory, memory.sparkSession, path, ["incident_id"])
    ids = [r.incident_id for r in new.select("incident_id").collect()]  # incidents that end in one run: few
    out = memory.select("incident_id", F.when(F.col("incident_id").isin(ids), "stored").otherwise("duplicate").alias("outcome")).distinct()
    new.write.mode("append").parquet(path)
    return out


def stream_events(parsed: DataFrame, root: str, checkpoint: str, **trigger):
    """Write a stream of events into the table that :func:`write_events` writes, each once, whoever has written
    it. A batch that runs again overwrites what it wrote the first time; streams are told apart by their
    checkpoints."""
    own = f"{zlib.crc32(checkpoint.encode()):08x}"

    def write(batch: DataFrame, batch_id: int) -> None:
        append_missing(signatures(batch).select("fingerprint", "template", "first_seen"), f"{root}/event_signatures", ["fingerprint"])
        name = f"{own}-{batch_id}"
        _write(_unwritten(batch, root, name), root, name, "overwrite")

    return parsed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
