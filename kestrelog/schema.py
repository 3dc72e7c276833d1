"""Schemas of the log entities."""

from pyspark.sql import types as T

S, TS, D = T.StringType(), T.TimestampType(), T.DoubleType()


def _of(*fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


RAW = _of(("source_id", S), ("line", S), ("received_at", TS), ("log_format", S), ("ord", T.LongType()))
EVENT = _of(
    ("event_id", S), ("timestamp", TS), ("service", S), ("source_id", S), ("severity", T.ShortType()), ("kind", S), ("message", S), ("template", S), ("fingerprint", S),
    ("trace_id", S), ("request_id", S), ("host", S), ("attributes", T.MapType(S, S)), ("ord", T.LongType()),
)
CLUSTER = _of(
    ("kind", S), ("service", S), ("key", S), ("window_start", TS), ("window_end", TS), ("event_count", T.LongType()), ("confidence", D),
    ("representative_events", T.ArrayType(S)), ("attributes", T.MapType(S, S)), ("detector", T.IntegerType()),
)
SCORES = _of(("temporal_proximity", D), ("trace_linkage", D), ("service_dependency", D), ("semantic_similarity", D), ("error_propagation", D))
EDGE = _of(("source_event", S), ("target_event", S), ("composite_score", D), ("strategy_scores", SCORES))
DEPENDENCY = _of(("service", S), ("dependency", S))
MEMORY = _of(
    ("incident_id", S), ("summary", S), ("root_cause", S), ("failure_chain", T.ArrayType(_of(("service", S), ("description", S), ("event_ref", S)))),
    ("affected_services", T.ArrayType(S)), ("remediation", S), ("created_at", TS),
)
STATUSES = ("detected", "analyzing", "completed", "failed")
