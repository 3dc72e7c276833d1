"""Lines made from known fields come back as these fields, in all formats; masks keep what they should."""

import json
import random
import re
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kestrelog.functions import text
from kestrelog.operators.parse import NAMES, parse
from kestrelog.schema import RAW

RECEIVED = datetime(2025, 3, 2, 8, tzinfo=UTC)
LEVELS = {"debug": 10, "info": 20, "notice": 20, "warn": 30, "Warning": 30, "ERR": 40, "error": 40, "fatal": 50, "strange": 20}
WORDS = ["basket", "shelf", "naïve", "straße", "item", "letter", "cart", "日本", "total", "slow"]


def run(spark, rows):
    """(source, line, format) in order -> parsed rows."""
    df = spark.createDataFrame([(s, line, RECEIVED, f, i) for i, (s, line, f) in enumerate(rows)], RAW)
    return parse(df).withColumn("us", F.unix_micros("timestamp")).orderBy("ord").collect()


def micros(at):
    return (at - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1)


def made(n, seed):
    rng = random.Random(seed)
    for _ in range(n):
        at = datetime(2025, 1, 1, tzinfo=UTC) + timedelta(milliseconds=rng.randrange(10**10))
        yield rng, at, rng.choice(list(LEVELS)), " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 6)))


def test_plain_lines_give_back_their_fields(spark):
    rows, want = [], []
    for rng, at, level, message in made(200, 1):
        stamp = at.strftime(rng.choice(["%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S"])) + rng.choice([".", ","]) + f"{at.microsecond // 1000:03d}" + rng.choice(["", "Z"])
        logger = rng.choice([None, "shop.gate", "a.b-c.d"])
        key = rng.choice([None, f"k-{rng.randrange(99)}"])
        full = message + (f" trace_id={key}" if key else "")
        rows.append(("/var/gate.log", f"{stamp} {rng.choice([level, f'[{level}]'])} {logger + ' ' if logger else ''}{full}  ", "plain"))
        want.append((micros(at), LEVELS[level], full, "gate", key, {"logger": logger} if logger else {}))
    assert [(r.us, r.severity, r.message, r.service, r.trace_id, r.attributes) for r in run(spark, rows)] == want


def test_json_lines_give_back_their_fields(spark):
    rows, want, times = [], [], []
    for rng, at, level, message in made(200, 2):
        names = {k: rng.choice(v) for k, v in NAMES.items()}
        when = rng.choice([at.isoformat(), at.timestamp()])
        fields = {names["ts"]: when, names["level"]: level, names["message"]: message, names["service"]: "stock", names["trace_id"]: "t9", names["host"]: "h1", "depth": rng.randrange(9), "open": True, "inner": {"a": [1]}, "list": [1], "none": None}
        rows.append(("x.jsonl", json.dumps(fields, ensure_ascii=rng.random() < 0.5), "json"))
        times.append(micros(at))
        want.append((LEVELS[level], message, "stock", "t9", "h1", {"depth": str(fields["depth"]), "open": "true"}))
    got = run(spark, rows)
    assert [(r.severity, r.message, r.service, r.trace_id, r.host, r.attributes) for r in got] == want
    assert all(abs(r.us - us) <= 1 for r, us in zip(got, times))


def test_json_odd_lines(spark):
    lines = ['{"msg": "first", "msg": "last", "n": 1, "n": 2}', "{broken", '{"message": ""}', '{"msg": 0, "level": "err"}', "[1, 2]", "", '{"time": "never", "ts": "2025-01-01", "msg": "m"}', '{"ts": 1e300, "msg": "far"}']
    got = run(spark, [("x.jsonl", line, "json") for line in lines])
    assert (got[0].message, got[0].attributes) == ("last", {"n": "2"})
    assert [r.message for r in got[1:3]] == lines[1:3] and (got[3].message, got[3].severity) == (lines[3], 40) and [r.message for r in got[4:6]] == ["[1, 2]", ""]
    assert {r.us for r in got} == {micros(RECEIVED)}


def test_container_lines_hold_any_line(spark):
    inner = ["2025-01-02 03:04:05 ERROR shop.gate lost 7 items", '{"time": "2025-01-02T03:04:05Z", "message": "lost", "stream": "own"}', "no time at all"]
    rows = [("docker:post-1", json.dumps({"log": line + "\n", "stream": "stderr", "time": "2025-06-01T00:00:00.5Z"}), "docker_json") for line in inner]
    got = run(spark, [*rows, ("docker:post-1", "not an envelope", "docker_json")])
    written = micros(datetime(2025, 1, 2, 3, 4, 5, tzinfo=UTC))
    assert [r.us for r in got] == [written, written, micros(datetime(2025, 6, 1, 0, 0, 0, 500000, tzinfo=UTC)), micros(RECEIVED)]
    assert [r.message for r in got] == ["lost 7 items", "lost", "no time at all", "not an envelope"] and {r.service for r in got} == {"post-1"}
    assert [r.attributes.get("stream") for r in got] == ["stderr"] * 3 + [None]


def test_web_server_lines(spark):
    got = run(spark, [("edge.log", f"2025/01/02 03:04:{i:02d} [{level}] {i}#0: upstream is away", "plain") for i, level in enumerate(["error", "warn", "crit"])])
    assert [(r.severity, r.kind, r.us) for r in got] == [(s, "external_call", micros(datetime(2025, 1, 2, 3, 4, i, tzinfo=UTC))) for i, s in enumerate((40, 30, 50))]


def test_masks_leave_no_digit_and_join_what_differs_by_values_alone(spark):
    rng = random.Random(3)
    frames = ["user {} paid {}", "from {} at {}", "page {} of {} read"]
    values = [lambda: str(rng.randrange(10**6)), lambda: f"{rng.random():.3f}", lambda: ".".join(str(rng.randrange(256)) for _ in range(4)), lambda: "-".join("%0*x" % (k, rng.randrange(16**k)) for k in (8, 4, 4, 4, 12)), lambda: f"0x{rng.randrange(2**32):X}", lambda: f"2025-0{rng.randint(1, 9)}-11 10:00:0{rng.randrange(10)}"]
    kinds = [(f, a, b) for f in range(3) for a in range(6) for b in range(6)]
    rows = [(k, frames[f].format(values[a](), values[b]())) for k, (f, a, b) in enumerate(kinds) for _ in range(4)]
    got = spark.createDataFrame(rows, "k int, m string").select("k", text.mask(F.col("m")).alias("t")).collect()
    templates = {}
    for r in got:
        templates.setdefault(r.k, set()).add(r.t)
    assert not any(re.search(r"\d", r.t) for r in got) and all(len(t) == 1 for t in templates.values())


@pytest.mark.parametrize("kind", [k for k, _, _ in text.KINDS])
def test_a_kind_is_the_first_that_matches(spark, kind):
    telling = {"task_retry": "retries left", "db_pool": "QueuePool is full", "db_query": "a deadlock", "external_call": "the webhook", "http_request": "PUT /shelf", "exception": "KeyError here", "lifecycle": "listening on 80"}
    order = [k for k, _, _ in text.KINDS]
    rows = [(f"{telling[other]} and {telling[kind]}", order[min(order.index(kind), order.index(other))]) for other in order]
    df = spark.createDataFrame(rows, "m string, want string").select(text.kind_of(F.col("m")).alias("k"), "want")
    assert all(r.k == r.want for r in df.collect())


def test_severity_lifts_exceptions_and_names_are_found_anywhere(spark):
    got = run(spark, [("a.log", "a KeyError in the cart", "plain"), ("a.log", "the cart is CRITICAL now", "plain"), ("a.log", "request_id=r-1 done", "plain"), (None, None, "plain")])
    assert [r.severity for r in got] == [40, 50, 20, 20] and got[2].request_id == "r-1" and (got[3].message, got[3].service) == ("", "")
    assert len({r.event_id for r in got}) == 4
