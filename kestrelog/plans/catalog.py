"""All queries of the log operators by name, and the DuckDB SQL that gives the same rows.

The events table stands for parsed logs: a fixed projection gives every row a service, severity, kind,
message, template and trace. Times leave as epoch microseconds, so no session time zone matters.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrelog.functions import text
from kestrelog.operators import correlate, detect, graph, memory, parse, query, vectorindex
from kestrelog.session import scratch
from kestrelog.streaming import detect as streaming
from kestrelog.streaming import metrics

FLAGSHIP = "error_rate"
DEPENDENCIES = [("svc-0", "svc-1"), ("svc-1", "svc-2"), ("svc-3", "svc-0")]
DAY = detect.Settings(seconds=86_400)
START, END = datetime(2024, 1, 10, tzinfo=UTC), datetime(2024, 1, 12, tzinfo=UTC)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def instant(column: str) -> F.Column:
    """A timestamp without zone as the instant it names in UTC."""
    return F.timestamp_micros(F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {column})"))


def us() -> F.Column:
    return F.unix_micros("timestamp").alias("us")


def project(rows: DataFrame) -> DataFrame:
    """The log projection of the events table."""
    kind = F.col("event_type")
    message = F.concat(kind, F.lit(" by user "), F.col("user_id").cast("string"), F.lit(" k="), F.get_json_object("props", "$.k"))
    return rows.select(
        "event_id", instant("ts").alias("timestamp"), F.concat(F.lit("svc-"), (F.col("user_id") % 5).cast("string")).alias("service"),
        F.when(kind == "error", 40).when(kind == "purchase", 30).when(kind == "click", 10).otherwise(20).cast("short").alias("severity"),
        F.when(kind == "error", "exception").when(kind == "click", "task_retry").when(kind == "purchase", "db_pool").when(kind == "view", "http_request").otherwise("lifecycle").alias("kind"),
        message.alias("message"), text.mask(message).alias("template"), F.concat(F.lit("t-"), F.col("user_id").cast("string")).alias("trace_id"),
        F.lit(None).cast("string").alias("request_id"), F.col("event_id").alias("ord"), "user_id", F.get_json_object("props", "$.k").cast("long").alias("k"),
    ).withColumn("fingerprint", text.fingerprint(F.col("template")))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(table(spark, sf_dir, "events"))


def services(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEPENDENCIES, "service string, dependency string")


EV = """e0 AS (SELECT event_id, ts, epoch_us(ts) AS us, user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
ev AS (SELECT event_id, us, user_id, k, 'svc-' || (user_id % 5) AS service, 't-' || user_id AS trace_id,
  CASE event_type WHEN 'error' THEN 40 WHEN 'purchase' THEN 30 WHEN 'click' THEN 10 ELSE 20 END AS severity,
  CASE event_type WHEN 'error' THEN 'exception' WHEN 'click' THEN 'task_retry' WHEN 'purchase' THEN 'db_pool' WHEN 'view' THEN 'http_request' ELSE 'lifecycle' END AS kind,
  event_type || ' by user ' || user_id || ' k=' || k AS message, event_type || ' by user <NUM> k=<NUM>' AS template,
  sha256(event_type || ' by user <NUM> k=<NUM>')[1:16] AS fingerprint FROM e0)"""
DEPS = "deps AS (SELECT * FROM (VALUES ('svc-0', 'svc-1'), ('svc-1', 'svc-2'), ('svc-3', 'svc-0')) t(service, dependency))"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# parsing


@register("SELECT doc_id, sha256(t)[1:16] AS fingerprint, length(t) AS n FROM (SELECT doc_id, " + "regexp_replace(" * 5 + "text" + "".join(f", '{p}', '{m}', 'g')" for m, p in text.MASKS) + " AS t FROM documents) q")
def mask_fingerprint(spark, sf_dir):
    t = text.mask(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", text.fingerprint(t).alias("fingerprint"), F.length(t).cast("long").alias("n"))


def _kind_sql(source: str, key: str) -> str:
    cases = " ".join(f"WHEN regexp_matches(text, '{'(?i)' if fold else ''}{p}') THEN '{k}'" for k, fold, p in text.KINDS)
    return f"SELECT {key}, CASE {cases} ELSE 'generic' END AS kind FROM {source}"


@register(_kind_sql("documents", "doc_id"))
def classify_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.kind_of(F.col("text"), "(?d)", "(?d)(?i)").alias("kind"))


@register(_kind_sql("conversations", "conv_id, turn"))
def classify_conversations(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.kind_of(F.col("text"), "(?d)", "(?d)(?i)").alias("kind"))


PARSED = f"WITH {EV} SELECT event_id AS ord, us, service, severity, message, template, trace_id{{more}} FROM ev"


@register(PARSED.format(more=", CAST(k AS VARCHAR) AS k"))
def parse_json_events(spark, sf_dir):
    level = F.when(F.col("severity") == 40, "error").when(F.col("severity") == 30, "warn").when(F.col("severity") == 10, "debug").otherwise("info")
    line = F.to_json(F.struct(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("ts"), level.alias("lvl"), F.col("message").alias("msg"), F.col("service").alias("app"), F.col("trace_id").alias("traceId"), F.col("k").alias("k")))
    raw = events(spark, sf_dir).select(F.lit("x.jsonl").alias("source_id"), line.alias("line"), F.current_timestamp().alias("received_at"), F.lit("json").alias("log_format"), "ord")
    return parse.parse(raw).select("ord", us(), "service", F.col("severity").cast("int").alias("severity"), "message", "template", "trace_id", F.col("attributes")["k"].alias("k"))


@register(f"WITH {EV} SELECT event_id AS ord, us // 1000 * 1000 AS us, 'app' AS service, severity, message || ' trace_id=' || trace_id AS message, trace_id, 'app.core' AS logger FROM ev")
def parse_plain_events(spark, sf_dir):
    level = F.when(F.col("severity") == 40, "ERROR").when(F.col("severity") == 30, "WARN").when(F.col("severity") == 10, "DEBUG").otherwise("INFO")
    line = F.concat(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss,SSS"), F.lit("Z "), level, F.lit(" app.core "), F.col("message"), F.lit(" trace_id="), F.col("trace_id"))
    raw = events(spark, sf_dir).select(F.lit("/var/log/app.log").alias("source_id"), line.alias("line"), F.current_timestamp().alias("received_at"), F.lit("plain").alias("log_format"), "ord")
    return parse.parse(raw).select("ord", us(), "service", F.col("severity").cast("int").alias("severity"), "message", "trace_id", F.col("attributes")["logger"].alias("logger"))


@register(f"WITH {EV} SELECT event_id AS ord, us // 1000 * 1000 AS us, 'api-1' AS service, severity, message, 'app.core' AS logger, CASE WHEN event_id % 2 = 0 THEN 'stderr' ELSE 'stdout' END AS stream FROM ev")
def parse_docker_events(spark, sf_dir):
    """Plain lines in container envelopes."""
    level = F.when(F.col("severity") == 40, "ERROR").when(F.col("severity") == 30, "WARN").when(F.col("severity") == 10, "DEBUG").otherwise("INFO")
    inner = F.concat(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"), F.lit(" "), level, F.lit(" app.core "), F.col("message"), F.lit("\n"))
    line = F.to_json(F.struct(inner.alias("log"), F.when(F.col("ord") % 2 == 0, "stderr").otherwise("stdout").alias("stream"), F.lit("2024-01-01T00:00:00Z").alias("time")))
    raw = events(spark, sf_dir).select(F.lit("docker:api-1").alias("source_id"), line.alias("line"), F.current_timestamp().alias("received_at"), F.lit("docker_json").alias("log_format"), "ord")
    return parse.parse(raw).select("ord", us(), "service", F.col("severity").cast("int").alias("severity"), "message", F.col("attributes")["logger"].alias("logger"), F.col("attributes")["stream"].alias("stream"))


@register(f"WITH {EV} SELECT event_id AS ord, us // 1000000 * 1000000 AS us, message, kind_of AS kind FROM (SELECT *, 'generic' AS kind_of FROM ev) q")
def parse_epoch_events(spark, sf_dir):
    """Times as epoch seconds, and a key that stands twice: its last value counts."""
    line = F.concat(F.lit('{"msg": "no", "ts": '), F.floor(F.unix_micros("timestamp") / 1_000_000).cast("string"), F.lit(', "msg": "'), F.col("message"), F.lit('"}'))
    raw = events(spark, sf_dir).select(F.lit("x.jsonl").alias("source_id"), line.alias("line"), F.current_timestamp().alias("received_at"), F.lit("json").alias("log_format"), "ord")
    return parse.parse(raw).select("ord", us(), "message", "kind")


# filters and reads


@register(f"WITH {EV}, s AS (SELECT fingerprint AS f, template AS t, min(us) AS first_us, count(*) AS n FROM ev GROUP BY 1, 2) SELECT event_id, template, first_us, n FROM ev JOIN s ON f = fingerprint")
def events_with_signatures(spark, sf_dir):
    e = events(spark, sf_dir)
    return query.with_signatures(e.drop("template"), query.signatures(e)).select("event_id", "template", F.unix_micros("first_seen").alias("first_us"), "n")



@register(f"WITH {EV} SELECT event_id, us, service, severity FROM ev WHERE us BETWEEN epoch_us(TIMESTAMP '2024-01-10') AND epoch_us(TIMESTAMP '2024-01-12') AND severity >= 30 AND service = 'svc-1'")
def window_filter(spark, sf_dir):
    return query.window(events(spark, sf_dir), START, END, "svc-1", 30).select("event_id", us(), "service", F.col("severity").cast("int").alias("severity"))


@register(f"WITH {EV} SELECT event_id, message FROM ev WHERE contains(lower(message), 'error by user 1') AND severity >= 40")
def search(spark, sf_dir):
    return query.search(events(spark, sf_dir), "ERROR by user 1", only_errors=True).select("event_id", "message")


@register(f"WITH {EV} SELECT event_id, template FROM ev WHERE fingerprint IN (SELECT fingerprint FROM ev WHERE event_id = 3)")
def similar_events(spark, sf_dir):
    return query.similar_to(events(spark, sf_dir), 3).select("event_id", "template")


@register(f"WITH {EV} SELECT CAST(event_id AS VARCHAR) AS id, service, CASE severity WHEN 10 THEN 'DEBUG' WHEN 20 THEN 'INFO' WHEN 30 THEN 'WARNING' ELSE 'ERROR' END AS severity, kind, message, trace_id FROM ev")
def event_digest(spark, sf_dir):
    return query.digest(events(spark, sf_dir)).drop("timestamp", "json")


# aggregates


@register(f"WITH {EV} SELECT service, us // 3600000000 * 3600 AS bucket, count(*) AS total, count(*) FILTER (WHERE severity >= 40) AS errors, round(count(*) FILTER (WHERE severity >= 40) / count(*), 4) AS ratio FROM ev GROUP BY 1, 2")
def error_rate(spark, sf_dir):
    return query.error_rate(events(spark, sf_dir), 3600)


@register(f"WITH {EV} SELECT service, us // 3600000000 * 3600 AS bucket, count(*) AS total, count(*) FILTER (WHERE severity >= 40) AS errors FROM ev GROUP BY 1, 2")
def stream_error_rate(spark, sf_dir):
    """The table as a stream of files, to its end."""
    schema = table(spark, sf_dir, "events").schema
    stream = project(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir))
    name = f"stream_error_rate_{abs(hash(sf_dir))}"
    spark.catalog.dropTempView(name)
    q = streaming.error_rate(stream, 3600).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).select("service", F.floor(F.unix_micros("bucket") / 1_000_000).alias("bucket"), "total", "errors")


@register(f"WITH {EV} SELECT service, count(*) AS n, min(us) AS first_us, max(us) AS last_us, arg_min(message, us) AS sample FROM ev WHERE kind = 'db_pool' GROUP BY 1")
def pool_pressure(spark, sf_dir):
    out = query.pool_pressure(events(spark, sf_dir))
    return out.select("service", "n", F.unix_micros("first_at").alias("first_us"), F.unix_micros("last_at").alias("last_us"), "sample")


@register(f"WITH {EV} SELECT fingerprint, template, min(us) AS first_us, count(*) AS n FROM ev GROUP BY 1, 2")
def signature_dimension(spark, sf_dir):
    return query.signatures(events(spark, sf_dir)).select("fingerprint", "template", F.unix_micros("first_seen").alias("first_us"), "n")


@register("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) q WHERE r = 1")
def latest_per_key(spark, sf_dir):
    return query.latest(table(spark, sf_dir, "orders"), ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey")


@register("SELECT role, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY role")
def usage_sums(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@register("WITH d AS (SELECT n_name AS a, r_name AS b FROM nation JOIN region ON n_regionkey = r_regionkey), u AS (SELECT a AS name, b AS x, NULL AS y FROM d UNION ALL SELECT b, NULL, a FROM d) SELECT name, array_to_string(list_sort(list(DISTINCT x) FILTER (WHERE x IS NOT NULL)), ',') AS depends_on, array_to_string(list_sort(list(DISTINCT y) FILTER (WHERE y IS NOT NULL)), ',') AS depended_on_by FROM u GROUP BY name".replace("array_to_string(list_sort(list(DISTINCT x) FILTER (WHERE x IS NOT NULL)), ',')", "coalesce(string_agg(DISTINCT x, ',' ORDER BY x), '')").replace("array_to_string(list_sort(list(DISTINCT y) FILTER (WHERE y IS NOT NULL)), ',')", "coalesce(string_agg(DISTINCT y, ',' ORDER BY y), '')"))
def dependency_lookup(spark, sf_dir):
    d = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    out = query.dependencies(d.select(F.col("n_name").alias("service"), F.col("r_name").alias("dependency")))
    return out.select("name", F.array_join("depends_on", ",").alias("depends_on"), F.array_join("depended_on_by", ",").alias("depended_on_by"))


@register("SELECT source AS source_id, count(*) AS n FROM documents GROUP BY source UNION ALL SELECT 'silent', 0")
def source_counts(spark, sf_dir):
    from kestrelog.sources import logs

    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("source_id"))
    names = sorted(r.source_id for r in docs.distinct().collect())
    return logs.counts(docs, [*names, "silent"])


@register(f"WITH {EV}, b AS (SELECT DISTINCT sha256(message)[1:16] AS f FROM ev WHERE us < epoch_us(TIMESTAMP '2024-01-15')) SELECT DISTINCT sha256(message)[1:16] AS fingerprint FROM ev WHERE us >= epoch_us(TIMESTAMP '2024-01-15') AND sha256(message)[1:16] NOT IN (SELECT f FROM b)")
def signature_upsert(spark, sf_dir):
    """What an insert-if-absent of the second half's messages would add to the first half's."""
    e = events(spark, sf_dir).withColumn("fingerprint", text.fingerprint(F.col("message")))
    cut = F.lit(datetime(2024, 1, 15, tzinfo=UTC)).cast("timestamp")
    old, new = e.filter(F.col("timestamp") < cut), e.filter(F.col("timestamp") >= cut)
    return new.select("fingerprint").distinct().join(old.select("fingerprint"), "fingerprint", "left_anti")


# detection

FREQUENCY = DAY.but(z=0.5, min_count=5)
_SERIES = """w AS (SELECT service, {key} AS key, us // 86400000000 AS idx, count(*) AS n, count(*) FILTER (WHERE severity >= 40) AS errors FROM ev {where} GROUP BY 1, 2, 3),
g AS (SELECT *, lag(idx) OVER (PARTITION BY service, key ORDER BY idx) AS before FROM w),
x0 AS (SELECT service, key, idx, n, errors, FALSE AS filler FROM g {gaps}),
x AS (SELECT *, row_number() OVER (PARTITION BY service, key ORDER BY idx) AS rn FROM x0)"""
_GAPS = "UNION ALL SELECT service, key, unnest(range(greatest(before + 1, idx - 50), idx)), 0, 0, TRUE FROM g WHERE before IS NOT NULL"
_FOLD = """f(service, key, idx, n, errors, filler, rn, mean, var, samples, m, v, s) AS (
  SELECT service, key, idx, n, errors, filler, rn, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), 0, CASE WHEN {w} >= 1 THEN CAST({v} AS DOUBLE) ELSE 0.3 * {w} * {v} END,
         CASE WHEN {w} >= 1 THEN CAST(0 AS DOUBLE) ELSE (1 - 0.3 * {w}) * 0.3 * {w} * {v} * {v} END, 1 FROM x WHERE rn = 1
  UNION ALL SELECT x.service, x.key, x.idx, x.n, x.errors, x.filler, x.rn, f.m, f.v, f.s, f.m + 0.3 * {wx} * ({vx} - f.m), (1 - 0.3 * {wx}) * (f.v + ({vx} - f.m) * 0.3 * {wx} * ({vx} - f.m)), f.s + 1
  FROM f JOIN x ON x.service = f.service AND x.key = f.key AND x.rn = f.rn + 1)"""


def _detector_sql(key: str, where: str, gaps: str, v: str, w: str, out: str) -> str:
    fold = _FOLD.format(v=v, w=w, vx=v.replace("n", "x.n").replace("errors", "x.errors") if v != "errors / n" else "x.errors / x.n", wx=w.replace("n /", "x.n /") if "n /" in w else w)
    return f"WITH RECURSIVE {EV}, {_SERIES.format(key=key, where=where, gaps=gaps)}, {fold} {out}"


def _clusters(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*more, "service", "key", F.floor(F.unix_micros("window_start") / 86_400_000_000).alias("day"), "event_count", F.round("confidence", 6).alias("confidence"))


_Z = "(n - mean) / greatest(sqrt(var), sqrt(greatest(mean, 1e-9)), 1e-9)"


@register(_detector_sql("fingerprint", "", _GAPS, "n", "1.0", f"SELECT service, key, idx AS day, n AS event_count, round(least(0.99, {_Z} / ({_Z} + 3)), 6) AS confidence FROM f WHERE NOT filler AND samples >= 3 AND n >= 5 AND {_Z} >= 0.5"))
def frequency_spikes(spark, sf_dir):
    return _clusters(detect.frequency_spikes(events(spark, sf_dir), FREQUENCY))


ERRORS = DAY.but(factor=1.2)


@register(_detector_sql("service", "", "", "errors / n", "least(n / 20, 1.0)", "SELECT service, key, idx AS day, errors AS event_count, round(least(0.99, (errors / n - mean) / greatest(errors / n, 1e-9)), 6) AS confidence FROM f WHERE samples >= 3 AND n >= 20 AND errors / n >= greatest(0.1, 1.2 * mean)"))
def error_ratios(spark, sf_dir):
    return _clusters(detect.error_ratios(events(spark, sf_dir), ERRORS))


RETRIES = DAY.but(min_retries=5, factor=1.2)
_SURGE = "(n / greatest(mean, 1.0))"


@register(_detector_sql("service", "WHERE kind = 'task_retry'", "", "n", "1.0", f"SELECT service, key, idx AS day, n AS event_count, round(least(0.99, {_SURGE} / ({_SURGE} + 3)), 6) AS confidence FROM f WHERE n >= 5 AND (n >= 1.2 * greatest(mean, 1.0) OR n >= 50)"))
def retry_storms(spark, sf_dir):
    return _clusters(detect.retry_storms(events(spark, sf_dir), RETRIES))


_NEW = f"""WITH {EV}, m AS (SELECT *, 'x' || k AS key FROM ev), o AS (SELECT *, row_number() OVER (ORDER BY us, event_id) AS r FROM m),
kn AS (SELECT service, key, min(r) AS known FROM o WHERE r <= 200 OR severity < 30 GROUP BY 1, 2)
SELECT o.service, o.key, min(us) // 86400000000 AS day, count(*) AS event_count, round(least(0.9, 0.7 + 0.02 * count(*)), 6) AS confidence
FROM o LEFT JOIN kn ON kn.service = o.service AND kn.key = o.key WHERE r > 200 AND severity >= 30 AND (known IS NULL OR r < known) GROUP BY 1, 2"""


@register(_NEW)
def new_signatures(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("fingerprint", F.concat(F.lit("x"), F.col("k").cast("string")))
    return _clusters(detect.new_signatures(e, DAY.but(learning=200)))


@register(" UNION ALL ".join(f"SELECT '{kind}' AS kind, service, key, day, event_count, confidence FROM ({SQL[name]}) q" for kind, name in (("frequency_spike", "frequency_spikes"), ("new_signature", "new_signatures"), ("error_ratio", "error_ratios"), ("retry_storm", "retry_storms"))))
def detect_all(spark, sf_dir):
    """All four detectors, each with its own settings, in one table."""
    e = events(spark, sf_dir)
    by_k = e.withColumn("fingerprint", F.concat(F.lit("x"), F.col("k").cast("string")))
    found = detect.frequency_spikes(e, FREQUENCY).unionByName(detect.new_signatures(by_k, DAY.but(learning=200))).unionByName(detect.error_ratios(e, ERRORS)).unionByName(detect.retry_storms(e, RETRIES))
    return _clusters(found, "kind")


_REPS = f"""SELECT q.day, q.service, e.event_id, e.r, q.confidence FROM ({SQL["retry_storms"]}) q
JOIN (SELECT *, us // 86400000000 AS day, row_number() OVER (PARTITION BY service, us // 86400000000 ORDER BY us, event_id) AS r FROM ev WHERE kind = 'task_retry') e
ON e.service = q.service AND e.day = q.day AND e.r <= 10"""


@register(f"WITH {EV} SELECT service, day, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY r) AS reps FROM ({_REPS}) x GROUP BY 1, 2")
def representatives(spark, sf_dir):
    """The events that stand for each retry storm, in order."""
    found = detect.retry_storms(events(spark, sf_dir), RETRIES)
    return found.select("service", F.floor(F.unix_micros("window_start") / 86_400_000_000).alias("day"), F.array_join("representative_events", ",").alias("reps"))


@register(f"WITH {EV} SELECT CAST(event_id AS VARCHAR) AS event_id, confidence AS boost FROM ({_REPS}) x")
def boosts(spark, sf_dir):
    return detect.boosts(detect.retry_storms(events(spark, sf_dir), RETRIES)).select("event_id", F.round("boost", 6).alias("boost"))


@register(f"WITH {EV}, reps AS ({_REPS}) SELECT event_id FROM ev WHERE severity >= 30 OR event_id IN (SELECT event_id FROM reps)")
def interesting_events(spark, sf_dir):
    e = events(spark, sf_dir)
    return query.interesting(e.withColumn("event_id", F.col("event_id").cast("string")), detect.retry_storms(e, RETRIES)).select(F.col("event_id").cast("long").alias("event_id"))


@register(f"WITH {EV}, reps AS ({_REPS}) SELECT service, day, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY r) AS reps FROM reps WHERE r <= 5 GROUP BY 1, 2")
def anomaly_details(spark, sf_dir):
    found = query.anomalies(detect.detect(events(spark, sf_dir), RETRIES, (detect.retry_storms, detect.error_ratios)), "retry_storm")
    return found.select("service", F.floor(F.unix_micros("window_start") / 86_400_000_000).alias("day"), F.array_join("representative_events", ",").alias("reps"))


# correlation

_PAIRS = f"""{EV}, {DEPS}, rel AS (SELECT service AS a, dependency AS b FROM deps UNION SELECT dependency, service FROM deps UNION SELECT DISTINCT service, service FROM ev),
hot AS (SELECT * FROM ev WHERE severity >= 30),
p AS (SELECT s.event_id AS src, t.event_id AS tgt, row_number() OVER (PARTITION BY s.event_id ORDER BY t.us, t.event_id) AS r FROM hot s JOIN hot t
  ON t.us - s.us BETWEEN 0 AND 3600000000 AND (t.us > s.us OR t.event_id > s.event_id)
  WHERE s.trace_id = t.trace_id OR s.fingerprint = t.fingerprint OR EXISTS (SELECT 1 FROM rel WHERE a = s.service AND b = t.service))"""


@register(f"WITH {_PAIRS} SELECT src, tgt FROM p WHERE r <= 10")
def candidate_pairs(spark, sf_dir):
    hot = events(spark, sf_dir).filter("severity >= 30")
    return correlate.candidates(hot, services(spark), horizon=3600, cap=10)


_SCORES = f"""WITH {_PAIRS}, q AS (SELECT s.event_id AS source_event, t.event_id AS target_event, exp(-3 * ((t.us - s.us) / 1000000.0) / 3600) AS tp, CASE WHEN s.trace_id = t.trace_id THEN 1.0 ELSE 0.0 END AS tl,
  CASE WHEN s.service = t.service THEN 0.8 WHEN EXISTS (SELECT 1 FROM deps WHERE deps.service = t.service AND dependency = s.service) THEN 1.0 WHEN EXISTS (SELECT 1 FROM deps WHERE deps.service = s.service AND dependency = t.service) THEN 0.6 ELSE 0.0 END AS sd,
  CASE WHEN s.kind = t.kind THEN 1.0 ELSE 1.0 / 3 END AS ss,
  CASE WHEN s.kind = 'exception' AND t.kind = 'db_pool' THEN 0.9 WHEN s.kind = 'exception' AND t.kind = 'exception' THEN 0.5 WHEN s.kind = 'db_pool' AND t.kind = 'db_pool' THEN 0.7 ELSE 0.0 END AS ep
  FROM p JOIN ev s ON s.event_id = src JOIN ev t ON t.event_id = tgt WHERE r <= 10),
c AS (SELECT *, (tp * 0.30 + tl * 0.25 + sd * 0.25 + ss * 0.20 + ep * 0.15) / 1.15 AS score FROM q)
SELECT source_event, target_event, round(score, 4) AS composite_score, round(tp, 4) AS temporal_proximity, tl AS trace_linkage, sd AS service_dependency, round(ss, 4) AS semantic_similarity, ep AS error_propagation FROM c WHERE score >= 0.35"""


@register(_SCORES)
def scored_edges(spark, sf_dir):
    hot = events(spark, sf_dir).filter("severity >= 30")
    ways = (correlate.Strategy("temporal_proximity", 0.30, correlate.temporal(3600)), *correlate.STRATEGIES[1:])
    out = correlate.correlate(hot, services(spark), 3600, 10, ways)
    return out.select("source_event", "target_event", "composite_score", "strategy_scores.*")


@register("""WITH t AS (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]{3,}'), lambda x: x NOT IN ('num', 'uuid', 'hex', 'the', 'for', 'and', 'with', 'while', 'after'))) AS w FROM documents),
p AS (SELECT a.doc_id, a.w AS x, b.w AS y FROM t a JOIN t b ON b.doc_id = a.doc_id + 1)
SELECT doc_id, round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) END, 6) AS jaccard FROM p""")
def token_jaccard(spark, sf_dir):
    """Word similarity of each document and the next."""
    w = table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("x"))
    p = w.join(w.select((F.col("doc_id") - 1).alias("doc_id"), F.col("x").alias("y")), "doc_id")
    both = F.size(F.array_intersect("x", "y"))
    return p.select("doc_id", F.round(F.when((F.size("x") == 0) | (F.size("y") == 0), 0.0).otherwise(both / (F.size("x") + F.size("y") - both)), 6).alias("jaccard"))


# graphs: one incident a user; an event leads to the user's next ones by what it carries


def _graph(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e = events(spark, sf_dir).filter("severity >= 30").withColumn("incident_id", F.col("user_id").cast("string")).withColumn("event_id", F.col("event_id").cast("string"))
    line = Window.partitionBy("incident_id").orderBy("timestamp", "ord")
    score = (0.5 + (F.col("k") % 50) / 100).alias("composite_score")
    near = e.select("incident_id", F.col("event_id").alias("source_event"), F.lead("event_id").over(line).alias("target_event"), "k", score).filter("k % 3 <> 0").drop("k")
    far = e.select("incident_id", F.col("event_id").alias("source_event"), F.lead("event_id", 2).over(line).alias("target_event"), "k", score).filter("k % 2 = 0").drop("k")
    return e, near.union(far).filter("target_event is not null")


_GRAPH = f"""{EV}, v AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS pos FROM ev WHERE severity >= 30),
ed AS (SELECT s.user_id, s.event_id AS a, t.event_id AS b FROM v s JOIN v t ON s.user_id = t.user_id AND (t.pos = s.pos + 1 AND s.k % 3 <> 0 OR t.pos = s.pos + 2 AND s.k % 2 = 0)),
r AS (SELECT user_id, a, b FROM ed UNION SELECT r.user_id, r.a, ed.b FROM r JOIN ed ON ed.user_id = r.user_id AND ed.a = r.b),
n AS (SELECT v.user_id, v.event_id, v.us, v.severity, v.pos, count(r.b) AS reach FROM v LEFT JOIN r ON r.user_id = v.user_id AND r.a = v.event_id GROUP BY ALL)"""


@register(f"WITH RECURSIVE {_GRAPH} SELECT CAST(user_id AS VARCHAR) AS incident_id, CAST(event_id AS VARCHAR) AS event_id, reach FROM n")
def reach(spark, sf_dir):
    return graph.reach(*_graph(spark, sf_dir)).select("incident_id", "event_id", "reach")


@register(f"""WITH RECURSIVE {_GRAPH},
z AS (SELECT user_id, count(*) AS size, min(us) AS low, greatest((max(us) - min(us)) / 1000000.0, 1e-9) AS span FROM v GROUP BY 1),
c AS (SELECT n.user_id, event_id, pos, CAST(reach + 1 AS DOUBLE) / size AS part, 1 - (us - low) / 1000000.0 / span AS early, CASE WHEN severity >= 40 THEN 0.9 ELSE 0.6 END AS impact
  FROM n JOIN z ON z.user_id = n.user_id WHERE event_id NOT IN (SELECT b FROM ed)),
o AS (SELECT *, round(0.45 * part + 0.30 * early + 0.25 * impact, 4) AS score FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, pos) AS rank FROM o)
SELECT CAST(user_id AS VARCHAR) AS incident_id, CAST(rank AS INTEGER) AS rank, CAST(event_id AS VARCHAR) AS event_id, CAST(round(CAST(score AS DECIMAL(9, 4)), 3) AS DOUBLE) AS score, CAST(round(CAST(part AS DECIMAL(9, 4)), 3) AS DOUBLE) AS reach, CAST(round(CAST(early AS DECIMAL(9, 4)), 3) AS DOUBLE) AS earliness, CAST(impact AS DOUBLE) AS impact FROM k WHERE rank <= 5""")
def root_candidates(spark, sf_dir):
    """The five likeliest roots of each incident: a top-k report."""
    found = graph.root_candidates(*_graph(spark, sf_dir))
    return found.select("incident_id", "rank", "event_id", F.round("score", 3).alias("score"), F.round("reach", 3).alias("reach"), F.round("earliness", 3).alias("earliness"), "impact")


@register(f"""WITH {EV}, v AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS pos FROM ev WHERE severity >= 30),
ed AS (SELECT s.user_id, s.event_id AS a, t.event_id AS b FROM v s JOIN v t ON s.user_id = t.user_id AND (t.pos = s.pos + 1 AND s.k % 3 <> 0 OR t.pos = s.pos + 2 AND s.k % 2 = 0) WHERE 0.5 + (s.k % 50) / 100.0 >= 0.8)
SELECT DISTINCT CAST(user_id AS VARCHAR) AS incident_id, CAST(unnest([a, b]) AS VARCHAR) AS event_id FROM ed""")
def pruned_vertices(spark, sf_dir):
    v, e = _graph(spark, sf_dir)
    return graph.prune(v, e, 0.8)[0].select("incident_id", "event_id")


@register(f"WITH {EV} SELECT CAST(user_id AS VARCHAR) AS incident_id, CAST(arg_max(event_id, (us, event_id)) AS VARCHAR) AS sink FROM ev WHERE severity >= 40 GROUP BY user_id")
def sink_events(spark, sf_dir):
    return graph.sinks(_graph(spark, sf_dir)[0])


@register(f"WITH {EV} SELECT CAST(user_id AS VARCHAR) AS incident_id, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS position, CAST(event_id AS VARCHAR) AS event_id FROM ev WHERE severity >= 30")
def timeline(spark, sf_dir):
    return graph.timelines(*_graph(spark, sf_dir))


_CYCLIC = _GRAPH.replace("t.pos = s.pos + 2 AND s.k % 2 = 0", "t.pos = s.pos + 2 AND s.k % 2 = 0 OR t.pos = s.pos - 2 AND s.k % 5 = 0")


@register(f"""WITH RECURSIVE {_CYCLIC}, m AS (SELECT DISTINCT a.user_id, a.a, a.b FROM r a JOIN r b ON a.user_id = b.user_id AND a.a = b.b AND a.b = b.a UNION SELECT user_id, event_id, event_id FROM v),
c AS (SELECT m.user_id, m.a, min_by(m.b, v.pos) AS component FROM m JOIN v ON v.user_id = m.user_id AND v.event_id = m.b GROUP BY ALL),
o AS (SELECT r.user_id, r.a, count(*) AS reach FROM r ANTI JOIN m ON m.user_id = r.user_id AND m.a = r.a AND m.b = r.b GROUP BY ALL)
SELECT CAST(c.user_id AS VARCHAR) AS incident_id, CAST(c.a AS VARCHAR) AS event_id, CAST(component AS VARCHAR) AS component, coalesce(reach, 0) AS reach FROM c LEFT JOIN o USING (user_id, a)""")
def cyclic_components(spark, sf_dir):
    """Strongly connected components, and what they lead to, with edges back in time."""
    v, e = _graph(spark, sf_dir)
    line = Window.partitionBy("incident_id").orderBy("timestamp", "ord")
    back = v.select("incident_id", F.col("event_id").alias("source_event"), F.lag("event_id", 2).over(line).alias("target_event"), F.lit(0.5).alias("composite_score"), "k").filter("k % 5 = 0").drop("k")
    return graph.reach(v, e.union(back.filter("target_event is not null")))


_CHAIN = f"""{EV}, v AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS pos, 0.5::DOUBLE + (k % 50) / 100.0::DOUBLE AS score FROM ev WHERE severity >= 30),
d AS (SELECT user_id, pos, 0.0::DOUBLE AS c0, 0 AS h0, [CAST(event_id AS VARCHAR)] AS p0, 'Infinity'::DOUBLE AS c1, 0 AS h1, []::VARCHAR[] AS p1 FROM v WHERE pos = 1
      UNION ALL SELECT user_id, pos, CASE WHEN far THEN c1 ELSE near END, CASE WHEN far THEN h1 ELSE h0 + 1 END, list_append(CASE WHEN far THEN p1 ELSE p0 END, name), leap, h0 + 1, p0 FROM (
        SELECT *, c1 < near OR c1 = near AND h1 <= h0 + 1 AS far FROM (
          SELECT d.user_id, b.pos, d.c0, d.h0, d.p0, d.c1, d.h1, d.p1, CAST(b.event_id AS VARCHAR) AS name,
                 CASE WHEN a.k % 3 <> 0 THEN d.c0 - ln(a.score) ELSE 'Infinity'::DOUBLE END AS near, CASE WHEN a.k % 2 = 0 THEN d.c0 - ln(a.score) ELSE 'Infinity'::DOUBLE END AS leap
          FROM d JOIN v a ON a.user_id = d.user_id AND a.pos = d.pos JOIN v b ON b.user_id = d.user_id AND b.pos = d.pos + 1))),
n AS (SELECT user_id, max(pos) AS pos, CAST(min_by(event_id, pos) AS VARCHAR) AS source, CAST(max_by(event_id, pos) AS VARCHAR) AS sink FROM v GROUP BY user_id)"""


@register(f"WITH RECURSIVE {_CHAIN} SELECT CAST(user_id AS VARCHAR) AS incident_id, source, sink, CASE WHEN isinf(c0) THEN '' ELSE array_to_string(p0, ',') END AS path, CASE WHEN isinf(c0) THEN 0 ELSE round(exp(-c0), 9) END AS strength FROM d JOIN n USING (user_id, pos)")
def strongest_chain(spark, sf_dir):
    """From the first to the last event of each incident."""
    v, e = _graph(spark, sf_dir)
    ends = v.groupBy("incident_id").agg(F.min_by("event_id", F.struct("timestamp", "ord")).alias("source"), F.max_by("event_id", F.struct("timestamp", "ord")).alias("sink"))
    out = graph.strongest_chains(v, e, ends)
    return out.select("incident_id", "source", "sink", F.array_join("path", ",").alias("path"), F.round("strength", 9).alias("strength"))


# memory

_EMBED = """{p}w AS (SELECT {key} AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{{2,}}')) AS w FROM {table}),
{p}h AS (SELECT id, sha256(w) AS h FROM {p}w),
{p}b AS (SELECT id, CAST('0x' || h[1:8] AS BIGINT) % 1024 AS bucket, sum(CASE WHEN CAST('0x' || h[9:10] AS BIGINT) % 2 = 0 THEN 1.0 ELSE -1.0 END) AS value FROM {p}h GROUP BY 1, 2),
{p}n AS (SELECT id, sqrt(sum(value * value)) AS norm FROM {p}b GROUP BY 1),
{p}e AS (SELECT id, bucket, CAST(value AS DOUBLE) / norm AS weight FROM {p}b JOIN {p}n USING (id) WHERE value <> 0)"""


@register("WITH " + _EMBED.format(p="", key="doc_id", table="documents") + " SELECT id AS doc_id, bucket, round(weight, 6) AS weight FROM e")
def hashing_embed(spark, sf_dir):
    return memory.embed(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "bucket", F.round("weight", 6).alias("weight"))


@register("""WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 5) AS distance FROM embeddings, q WHERE vec_id <> 0 ORDER BY 1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), vec_id LIMIT 10""")
def cosine_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    one = vectors.filter("vec_id = 0").first().embedding
    return memory.nearest(vectors, list(one), "vec_id", "embedding", 10, F.col("vec_id") == 0).select("vec_id", F.round("distance", 5).alias("distance"))


@register("""WITH q AS (SELECT vec_id AS question, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 50 = 0),
d AS (SELECT question, vec_id AS key, round(1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 12) AS distance FROM embeddings, q WHERE vec_id <> question),
r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY distance, key) AS rank FROM d)
SELECT question, rank, key, round(distance, 5) AS distance FROM r WHERE rank <= 10""")
def indexed_neighbours(spark, sf_dir):
    """For every fiftieth vector its ten nearest of all, exactly, through an inverted-file index of all vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    index = vectorindex.build(vectors, "vec_id", "embedding", scratch(spark, "index"))
    questions = vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("question"), F.col("embedding").alias("vector"), F.col("vec_id").alias("exclude"))
    return vectorindex.search(index, questions, 10, exact=True).select("question", F.col("rank").cast("long").alias("rank"), "key", F.round("distance", 5).alias("distance"))


@register("WITH " + _EMBED.format(p="m", key="doc_id", table="documents") + ", " + _EMBED.format(p="q", key="item_id", table="benchmark") + """,
d AS (SELECT qe.id AS question, me.id AS doc_id, sum(qe.weight * me.weight) AS s FROM qe JOIN me USING (bucket) GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY round(s, 9) DESC, doc_id) AS r FROM d)
SELECT question, doc_id, round(s, 4) AS similarity FROM t WHERE r <= 3 AND s >= 0.3""")
def recall(spark, sf_dir):
    """For each benchmark item the three documents most like it."""
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question"), "text", F.lit(None).cast("long").alias("exclude"))
    return memory.similar(table(spark, sf_dir, "documents").select("doc_id", "text"), questions, "doc_id")


# metrics


@register("""WITH b AS (SELECT event_type, CASE WHEN value > 0 THEN CAST(ceil(ln(value) / ln(1.01::DOUBLE / 0.99::DOUBLE)) AS INT) ELSE -2147483648 END AS bucket, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL),
u AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY bucket) AS up, sum(n) OVER (PARTITION BY event_type) AS total FROM b),
q AS (SELECT event_type, share, min(bucket) AS bucket, max(total) AS n FROM u, (SELECT unnest([0.5, 0.95, 0.99])::DOUBLE AS share) WHERE up >= greatest(ceil(share * total), 1) GROUP BY ALL)
SELECT event_type, CAST(n AS BIGINT) AS n, share, CASE WHEN bucket = -2147483648 THEN 0 ELSE round(exp(bucket * ln(1.01::DOUBLE / 0.99::DOUBLE)) * 0.99, 6) END AS value FROM q""")
def value_quantiles(spark, sf_dir):
    """Quantiles of a number by label, from mergeable histograms."""
    found = metrics.quantiles(metrics.histogram(table(spark, sf_dir, "events"), ["event_type"], "value"), ["event_type"], [0.5, 0.95, 0.99])
    return found.withColumn("value", F.round("value", 6))


@register("SELECT 'u' || user_id AS label, max_by(value, (ts, value)) AS value, epoch_us(max(ts)) AS us FROM events WHERE value IS NOT NULL GROUP BY ALL")
def last_values(spark, sf_dir):
    """Each user's last number."""
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("label"), "value", instant("ts").alias("timestamp"))
    return metrics.gauges(rows, ["label"], "value").select("label", "value", F.unix_micros("at").alias("us"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
