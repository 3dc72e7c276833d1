"""Masking, fingerprints, kinds, severities and timestamps of log messages, as columns.

Patterns run with Unicode classes and with line feed as the only line end, so that they mean the same
for every message whatever it holds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

U = "(?U)(?d)"  # Unicode classes; only \n ends a line
UI = "(?U)(?d)(?iu)"

# Formats, names and weights that inputs and results depend on.
STAMP = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?"
MASKS = [
    ("<TS>", r"\d{4}[-/]\d{2}[-/]\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?"),
    ("<UUID>", r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"),
    ("<IP>", r"\b(?:\d{1,3}\.){3}\d{1,3}(?::\d+)?\b"),
    ("<HEX>", r"\b0x[0-9a-fA-F]+\b|\b[0-9a-f]{12,}\b"),
    ("<NUM>", r"\d+(?:\.\d+)?"),
]
KINDS = [
    ("task_retry", True, r"\bretr(?:y|ying|ies|ied)\b"),
    ("db_pool", True, r"connection pool|pool (?:exhaust|timeout|limit|size)|too many connections|remaining connection slots|QueuePool"),
    ("db_query", True, r"\b(?:SELECT|INSERT|UPDATE|DELETE)\b.*\b(?:FROM|INTO|SET|WHERE)\b|sqlalchemy|deadlock|\bquery\b|database session"),
    ("external_call", True, r"\bstripe\b|external api|upstream|third[- ]party|webhook"),
    ("http_request", False, r"\b(?:GET|POST|PUT|PATCH|DELETE)\s+/\S*|\bHTTP/\d"),
    ("exception", True, r"\btraceback\b|\b\w+(?:Error|Exception)\b|\bpanic\b"),
    ("lifecycle", True, r"\b(?:starting|started|stopping|stopped|shut(?:ting)? ?down|listening on|booted)\b"),
]
SEVERITIES = {"DEBUG": 10, "INFO": 20, "WARNING": 30, "ERROR": 40, "CRITICAL": 50}
SEVERITY_NAMES = {
    "TRACE": 10, "DEBUG": 10, "INFO": 20, "NOTICE": 20, "WARN": 30, "WARNING": 30, "ERR": 40, "ERROR": 40, "EXCEPTION": 40,
    "CRIT": 50, "CRITICAL": 50, "FATAL": 50, "ALERT": 50, "EMERG": 50, "PANIC": 50,
}


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def mask(message: Column, flags: str = U) -> Column:
    """The message's template: variable parts as placeholders, in a fixed order."""
    return reduce(lambda c, m: F.regexp_replace(c, flags + m[1], m[0]), MASKS, message)


def fingerprint(template: Column) -> Column:
    return F.substring(F.sha2(template, 256), 1, 16)


def kind_of(message: Column, flags: str = U, fold: str = UI) -> Column:
    """The first kind whose pattern the message holds, else generic."""
    chain = None
    for kind, any_case, pattern in KINDS:
        hit = message.rlike((fold if any_case else flags) + pattern)
        chain = F.when(hit, kind) if chain is None else chain.when(hit, kind)
    return chain.otherwise("generic")


def severity_of(text: Column, default: int = 20) -> Column:
    names = F.create_map(*[F.lit(x) for pair in SEVERITY_NAMES.items() for x in pair])
    return F.coalesce(names[F.upper(strip(text))], F.lit(default)).cast("short")


def severity_name(severity: Column) -> Column:
    names = F.create_map(*[F.lit(x) for name, number in SEVERITIES.items() for x in (number, name)])
    return names[severity.cast("int")]


def timestamp_of(text: Column) -> Column:
    """A timestamp from text: decimal comma, slashes, more than six digits and no zone are all fine;
    null if it isn't one."""
    t = F.regexp_replace(strip(text), ",", ".")
    t = F.regexp_replace(t, r"^(\d{4})/(\d{2})/(\d{2})", "$1-$2-$3")
    t = F.regexp_replace(t, r"(\.\d{6})\d+", "$1")
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), t.try_cast("timestamp"))


def epoch_of(seconds: Column) -> Column:
    """A timestamp from epoch seconds; null outside the years 1 to 9999."""
    inside = (seconds >= -62135596800.0) & (seconds < 253402300800.0)
    return F.when(inside, F.timestamp_micros((seconds * 1000000).cast("long")))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6)


def tokens(template: Column) -> Column:
    """Distinct words of three letters or more, without stop words (fixed values)."""
    stop = ["num", "uuid", "hex", "the", "for", "and", "with", "while", "after"]
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(template), F.lit("([a-z]{3,})"), F.lit(1))), F.array(*map(F.lit, stop)))
