"""Raw lines to typed events: one projection, no shuffle and no Python in the plan.

Lines are plain text (level-first or web-server error lines, or anything), JSON objects, or container
records whose ``log`` is one of the two. What can't be read as its format is read as plain text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrelog.functions.text import STAMP, U, epoch_of, fingerprint, kind_of, mask, severity_of, strip, timestamp_of

# Line formats and the names that fields go by.
LEVEL_FIRST = U + rf"^({STAMP})\s+\[?([A-Za-z]+)\]?:?\s+(?:([\w.\-]+(?:\.[\w\-]+)+)\s+)?(.*)$"
WEB_ERROR = U + r"^(\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}) \[(\w+)\] (.*)$"
ANY_LEVEL = U + r"\b(DEBUG|TRACE|INFO|NOTICE|WARNING|WARN|ERROR|ERR|CRITICAL|CRIT|FATAL|ALERT)\b"
TRACE_ID = r"(?U)(?d)(?iu)\btrace[_-]?id[=:]\s*\"?([\w-]+)"
REQUEST_ID = r"(?U)(?d)(?iu)\b(?:request[_-]?id|req[_-]?id)[=:]\s*\"?([\w-]+)"
NAMES = {
    "ts": ["timestamp", "time", "ts", "@timestamp", "asctime"],
    "level": ["level", "severity", "levelname", "lvl"],
    "message": ["message", "msg", "event"],
    "service": ["service", "app", "application", "service_name"],
    "trace_id": ["trace_id", "traceId", "trace", "otelTraceID"],
    "request_id": ["request_id", "requestId", "req_id"],
    "host": ["host", "hostname", "instance"],
}


def found(text: Column, pattern: str) -> Column:
    """The first group, or null if the pattern isn't there or the group is empty."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def default_service(source_id: Column) -> Column:
    """The file name of a path without its last suffix."""
    name = F.regexp_extract(F.translate(source_id, "\\", "/"), r"([^/]+?)(?:\.[^./]*)?$", 1)
    return F.when(name == "", source_id).otherwise(name)


def plain(text: Column, service: Column) -> Column:
    """Fields of a plain line; ts is null where the line has none."""
    text = strip(text)
    first, web = text.rlike(LEVEL_FIRST), text.rlike(WEB_ERROR)
    get = lambda pattern, i: F.regexp_extract(text, pattern, i)
    logger = F.nullif(get(LEVEL_FIRST, 3), F.lit(""))
    return F.struct(
        F.when(first, timestamp_of(get(LEVEL_FIRST, 1))).when(web, timestamp_of(get(WEB_ERROR, 1))).alias("ts"),
        F.when(first, severity_of(get(LEVEL_FIRST, 2))).when(web, severity_of(get(WEB_ERROR, 2))).otherwise(severity_of(get(ANY_LEVEL, 1))).alias("severity"),
        F.when(first, strip(get(LEVEL_FIRST, 4))).when(web, strip(get(WEB_ERROR, 3))).otherwise(text).alias("message"),
        service.alias("service"),
        found(text, TRACE_ID).alias("trace_id"),
        found(text, REQUEST_ID).alias("request_id"),
        F.lit(None).cast("string").alias("host"),
        F.when(first & logger.isNotNull(), F.create_map(F.lit("logger"), logger)).otherwise(F.create_map().cast("map<string,string>")).alias("attributes"),
    )


def json(fields: Column, raw_ts: Column, text: Column, service: Column) -> Column:
    """Fields of a JSON object, given as a map of variants; ``raw_ts`` is the value of the first name of a
    time that isn't null, which decides, readable or not."""
    as_text = lambda x: F.try_variant_get(x, "$", "string")

    def first(names: list[str]) -> Column:
        return F.coalesce(*[as_text(fields[n]) for n in names])

    number, kind = F.try_variant_get(raw_ts, "$", "double"), F.schema_of_variant(raw_ts)
    stamp = F.when(kind == "STRING", timestamp_of(as_text(raw_ts))).when(kind.rlike("BIGINT|DOUBLE|DECIMAL|FLOAT|INT"), epoch_of(number))
    message = first(NAMES["message"])
    used = [n for names in NAMES.values() for n in names]
    scalar = F.map_filter(fields, lambda k, x: ~k.isin(used) & ~F.schema_of_variant(x).rlike("^(OBJECT|ARRAY|VOID)"))
    return F.struct(
        stamp.alias("ts"),
        severity_of(F.coalesce(first(NAMES["level"]), F.lit(""))).alias("severity"),
        F.when(message.isNull() | message.isin("", "0", "false"), text).otherwise(strip(message)).alias("message"),
        F.coalesce(F.nullif(first(NAMES["service"]), F.lit("")), service).alias("service"),
        first(NAMES["trace_id"]).alias("trace_id"),
        first(NAMES["request_id"]).alias("request_id"),
        first(NAMES["host"]).alias("host"),
        F.transform_values(scalar, lambda k, x: as_text(x)).alias("attributes"),
    )


def parse(raw: DataFrame) -> DataFrame:
    """Events of raw records (source_id, line, received_at, log_format plain|json|docker_json, ord).

    Event ids come from source and position, so a second run gives the same. Null lines count as
    empty. A record without a readable time has its time of receipt. Of a key that a JSON object repeats
    the last value counts (a setting of the session's variants). Each line is parsed once: what several
    fields need is a column of its own.
    """
    raw.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    line, source = F.coalesce("line", F.lit("")), F.coalesce("source_id", F.lit(""))
    docker, plain_format = F.col("log_format") == "docker_json", F.col("log_format") == "plain"
    looks = lambda c: c.rlike(r"(?s)^\s*\{.*\}\s*$")
    raw = raw.withColumn("_service", F.when(docker, F.regexp_replace(source, "^docker:", "")).otherwise(default_service(source)))
    raw = raw.withColumn("_v", F.when(docker & looks(line), F.try_parse_json(line)))
    raw = raw.withColumn("_log", F.try_variant_get("_v", "$.log", "string"))
    raw = raw.withColumn("_text", F.when(F.col("_log").isNotNull(), F.regexp_replace("_log", r"\n+$", "")).otherwise(line))
    text, envelope = F.col("_text"), F.col("_log").isNotNull()
    raw = raw.withColumn("_o", F.when(((F.col("log_format") == "json") | envelope) & ~plain_format & looks(text), F.try_parse_json(strip(text))))
    raw = raw.withColumn("_m", F.try_variant_get("_o", "$", "map<string,variant>"))
    stamps = [F.when(F.try_variant_get(F.col("_m")[n], "$", "string").isNotNull(), F.col("_m")[n]) for n in NAMES["ts"]]
    raw = raw.withColumn("_ts", F.coalesce(*stamps))
    raw = raw.withColumn("_f", F.when(F.col("_m").isNotNull(), json(F.col("_m"), F.col("_ts"), strip(text), F.col("_service"))).otherwise(plain(text, F.col("_service"))))
    stream = F.nullif(F.try_variant_get("_v", "$.stream", "string"), F.lit(""))
    written = timestamp_of(F.try_variant_get("_v", "$.time", "string"))
    raw = raw.withColumn("_message", F.col("_f.message")).withColumn("_kind", kind_of(F.col("_message"))).withColumn("_template", mask(F.col("_message")))
    return raw.select(
        F.sha2(F.concat_ws(":", source, F.col("ord").cast("string")), 256).alias("event_id"),
        F.coalesce("_f.ts", F.when(envelope, written), "received_at").alias("timestamp"),
        F.col("_f.service").alias("service"),
        source.alias("source_id"),
        F.when(F.col("_kind") == "exception", F.greatest(F.col("_f.severity"), F.lit(40).cast("short"))).otherwise(F.col("_f.severity")).alias("severity"),
        F.col("_kind").alias("kind"),
        F.col("_message").alias("message"),
        F.col("_template").alias("template"),
        F.col("_f.trace_id").alias("trace_id"),
        F.col("_f.request_id").alias("request_id"),
        F.col("_f.host").alias("host"),
        F.when(envelope & stream.isNotNull(), F.map_concat(F.map_filter(F.col("_f.attributes"), lambda k, _: k != "stream"), F.create_map(F.lit("stream"), stream))).otherwise(F.col("_f.attributes")).alias("attributes"),
        F.col("ord").cast("long").alias("ord"),
        fingerprint(F.col("_template")).alias("fingerprint"),
    )
