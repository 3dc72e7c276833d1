"""Detection, correlation, graphs, memory, sinks, sources, tools and streams on small inputs."""

import itertools
import math
import time
from datetime import UTC, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrelog.investigate import agents, tools
from kestrelog.operators import correlate, detect, evidence, graph, memory, query
from kestrelog.operators.parse import parse
from kestrelog.schema import EVENT
from kestrelog.session import settled
from kestrelog.sinks import tables
from kestrelog.sources import logs, repo
from kestrelog.streaming import detect as streaming

BASE = datetime(2026, 7, 6, 14, 0, tzinfo=UTC)


def make(spark, rows):
    """Events of (seconds, service, severity, kind, template, trace)."""
    data = [(f"e{i}", BASE + timedelta(seconds=s), svc, "src", sev, kind, t, t, t, trace, None, None, None, i) for i, (s, svc, sev, kind, t, trace) in enumerate(rows)]
    return spark.createDataFrame(data, EVENT)


def steady(counts, svc="a", sev=20, kind="generic", t="tick"):
    return [(10 * w + 9 * i / max(n, 1), svc, sev, kind, t, None) for w, n in enumerate(counts) for i in range(n)]


def test_baseline():
    b = detect.Baseline()
    for _ in range(10):
        b.add(4.0)
    assert abs(b.z(10) - 3) < 1e-9 and detect.Baseline().z(5) == 0
    b = detect.Baseline()
    b.add(1.0, 0.5)
    assert abs(b.mean - 0.15) < 1e-12
    b.add(9.0, 0)
    assert b.samples == 1


def test_frequency(spark):
    got = detect.frequency_spikes(make(spark, steady([5, 5, 5, 5, 5, 100]))).collect()
    assert len(got) == 1 and got[0].event_count == 100 and len(got[0].representative_events) == 10
    assert got[0].window_start.timestamp() == (BASE + timedelta(seconds=50)).timestamp()
    assert detect.frequency_spikes(make(spark, steady([100]))).count() == 0
    gap = detect.frequency_spikes(make(spark, steady([5, 0, 0, 0, 0, 0, 40]))).collect()
    assert [r.event_count for r in gap] == [40]


def test_new_signature(spark):
    rows = [(i, "a", 20, "generic", "known", None) for i in range(3)] + [(10 + i, "a", 40, "generic", "new", None) for i in range(3)] + [(20, "a", 20, "generic", "mild", None), (21, "a", 40, "generic", "mild", None)]
    got = detect.new_signatures(make(spark, rows), detect.Settings(learning=3)).collect()
    assert [(r.key, r.event_count, round(r.confidence, 2)) for r in got] == [("new", 3, 0.76)]


def test_error_ratio_and_retries(spark):
    rows = []
    for w in range(5):
        bad = 25 if w == 4 else 1
        rows += [(10 * w + i * 0.19, "a", 40 if i < bad else 20, "generic", "t", None) for i in range(50)]
    got = detect.error_ratios(make(spark, rows)).collect()
    assert len(got) == 1 and got[0].event_count == 25 and got[0].confidence > 0.9 and got[0].attributes["total"] == "50"
    assert detect.error_ratios(make(spark, steady([3, 3, 3, 3], sev=40))).count() == 0
    got = detect.retry_storms(make(spark, steady([2, 2, 2, 40], kind="task_retry"))).collect()
    assert [r.event_count for r in got] == [40] and got[0].confidence > 0.7
    assert detect.retry_storms(make(spark, steady([200], sev=40))).count() == 0


def test_detect_on_nothing(spark):
    none = make(spark, [])
    assert detect.detect(none).count() == 0 and query.error_rate(none).count() == 0


def test_streams_agree_with_batch(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = sorted((float(rng.uniform(0, 300)), str(rng.choice(["a", "b"])), int(rng.choice([20, 40])), "task_retry" if rng.random() < 0.4 else "generic", str(rng.choice(["t1", "t2"])), None) for _ in range(900))
    e = make(spark, rows + [(250 + i * 0.01, "a", 40, "task_retry", "t1", None) for i in range(80)])
    beat = make(spark, [(2000, s, 20, k, t, None) for s in "ab" for t in ("t1", "t2") for k in ("generic", "task_retry")]).withColumn("ord", F.lit(10**9).cast("long"))
    e.repartition(1).write.parquet(f"{tmp_path}/in/0")
    beat.repartition(1).write.parquet(f"{tmp_path}/in/1")
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    s = detect.Settings(z=1.0, min_count=5, min_events=10, min_ratio=0.05, factor=1.0)
    for name, batch in (("frequency_spikes", detect.frequency_spikes), ("error_ratios", detect.error_ratios), ("retry_storms", detect.retry_storms)):
        q = getattr(streaming, name)(stream, s).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination()
        key = lambda r: (r.service, r.key, r.window_start, r.event_count, round(r.confidence, 9), tuple(r.representative_events))
        got, want = sorted(map(key, spark.table(name).collect())), sorted(map(key, batch(e, s).collect()))
        assert got == want and want, name


def brute_pairs(rows, deps, horizon, cap):
    rel = {(a, b) for a, b in deps} | {(b, a) for a, b in deps}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0], i))
    out = set()
    for p, i in enumerate(order):
        n = 0
        for j in order[p + 1 :]:
            if round(rows[j][0] * 1e6) - round(rows[i][0] * 1e6) > horizon * 1e6 or n == cap:
                break
            a, b = rows[i], rows[j]
            if (a[5] is not None and a[5] == b[5]) or a[4] == b[4] or a[1] == b[1] or (a[1], b[1]) in rel:
                out.add((f"e{i}", f"e{j}"))
                n += 1
    return out


@pytest.mark.parametrize(("cap", "horizon"), [(5, 60), (50, 7), (3, 200)])
def test_candidates(spark, cap, horizon):
    rng = np.random.default_rng(cap)
    rows = [(round(float(x), 1), str(rng.choice(list("abcd"))), 40, "generic", f"t{rng.integers(0, 9)}", f"x{rng.integers(0, 40)}" if rng.random() < 0.5 else None) for x in rng.uniform(0, 400, 400)]
    deps = [("a", "b"), ("c", "a")]
    got = {(r.src, r.tgt) for r in correlate.candidates(make(spark, rows), spark.createDataFrame(deps, "service string, dependency string"), horizon, cap).collect()}
    assert got == brute_pairs(rows, deps, horizon, cap)


def test_scores(spark):
    rows = [(0, "pay", 40, "external_call", "stripe timeout", "t1"), (1, "api", 40, "exception", "timeout error", "t1"), (2, "api", 40, "db_pool", "pool exhausted", None), (50, "other", 20, "generic", "nothing alike", None)]
    deps = spark.createDataFrame([("api", "pay")], "service string, dependency string")
    got = {(r.source_event, r.target_event): r for r in correlate.correlate(make(spark, rows), deps).collect()}
    assert set(got) == {("e0", "e1"), ("e0", "e2"), ("e1", "e2")}
    r = got["e0", "e1"]
    assert r.strategy_scores.asDict() == {"temporal_proximity": round(math.exp(-3 / 60), 4), "trace_linkage": 1.0, "service_dependency": 1.0, "semantic_similarity": round(1 / 3, 4), "error_propagation": 0.8}
    assert abs(r.composite_score - (0.3 * math.exp(-0.05) + 0.5 + 0.2 / 3 + 0.12) / 1.15) < 1e-4
    with pytest.raises(ValueError):
        correlate.score(None, None, None, ())


def graph_frames(spark, names, edges, sev=40):
    v = spark.createDataFrame([("i", n, BASE + timedelta(seconds=k), k, sev, "s") for k, n in enumerate(names)], "incident_id string, event_id string, timestamp timestamp, ord long, severity int, service string")
    return v, spark.createDataFrame([("i", a, b, float(c)) for a, b, c in edges], "incident_id string, source_event string, target_event string, composite_score double")


def test_graph_roots_and_cycles(spark):
    v, e = graph_frames(spark, "abcd", [("a", "b", 0.9), ("b", "c", 0.9), ("c", "a", 0.9), ("c", "d", 0.5)])
    r = {x.event_id: x for x in graph.reach(v, e).collect()}
    assert {x.component for x in r.values()} == {"a", "d"} and r["b"].reach == 1 and r["d"].reach == 0
    top = graph.root_candidates(v, e).collect()
    assert [(x.event_id, x.members, x.reach, x.earliness) for x in top] == [("a", 3, 1.0, 1.0)] and abs(top[0].score - round(0.45 + 0.3 + 0.25 * 0.9, 4)) < 1e-9
    boost = spark.createDataFrame([("b", 0.99)], "event_id string, boost double")
    assert graph.root_candidates(v, e, boost).first().impact == 0.99
    assert [x.event_id for x in graph.timelines(v, e).orderBy("position").collect()] == list("abcd")
    with pytest.raises(ValueError):
        graph.build(v, graph_frames(spark, "a", [("a", "zz", 1)])[1])
    pv, pe = graph.prune(v, e, 0.8)
    assert {x.event_id for x in pv.collect()} == set("abc") and pe.count() == 3
    assert graph.root_candidates(*graph_frames(spark, "a", [("a", "a", 1)])).count() == 1


def test_graph_root_scores_round_halves_up(spark):
    """The first of 24 events, alone, scores 0.54375: in four digits as much as a later one with 0.54381."""
    at = [0, 437.3, *range(500, 521), 1000]
    rows = [("i", f"e{k:02}", BASE + timedelta(seconds=t), k, 30 if k else 40, None) for k, t in enumerate(at)]
    v = spark.createDataFrame(rows, "incident_id string, event_id string, timestamp timestamp, ord long, severity int, boost double")
    e = spark.createDataFrame([("i", "e01", f"e{k:02}", 0.5) for k in range(2, 13)], "incident_id string, source_event string, target_event string, composite_score double")
    for limit in (100, 1):  # in one task, and by rounds
        found = graph.root_candidates(v, e, top=2, limit=limit).orderBy("rank").collect()
        assert [(x.event_id, x.score, x.reach, x.earliness) for x in found] == [("e00", 0.5438, 0.0417, 1.0), ("e01", 0.5438, 0.5, 0.5627)]


def test_strongest_chain(spark):
    rng = np.random.default_rng(1)
    names = [f"n{i:02d}" for i in range(9)]
    edges = [(a, b, round(float(rng.uniform(0.1, 1)), 3)) for a, b in itertools.combinations(names, 2) if rng.random() < 0.5]
    v, e = graph_frames(spark, names, edges)
    ends = spark.createDataFrame([("i", names[0], x) for x in names[1:]] + [("i", "zz", names[1])], "incident_id string, source string, sink string")
    got = {r.sink if r.source == names[0] else "zz": r for r in graph.strongest_chains(v, e, ends).collect()}
    weight = {(a, b): c for a, b, c in edges}
    for x in names[1:]:
        best = 0.0
        for k in range(len(names)):
            for middle in itertools.combinations([n for n in names if names[0] < n < x], k):
                path = [names[0], *middle, x]
                best = max(best, math.prod(weight.get(p, 0.0) for p in itertools.pairwise(path)))
        assert abs(got[x].strength - best) < 1e-9
    assert got["zz"].path == []


def test_memory(spark):
    rows = [("i1", "stripe timeout exhausted the pool", None), ("i2", "disk full on host", None), ("i3", "", None)]
    m = spark.createDataFrame(rows, "incident_id string, text string, x string")
    q = spark.createDataFrame([("q", "pool exhausted after stripe timeout", None), ("r", "pool exhausted after stripe timeout", "i1")], "question string, text string, exclude string")
    got = memory.similar(m, q).collect()
    assert [(r.question, r.incident_id) for r in got] == [("q", "i1")] and got[0].similarity > 0.5
    d = memory.dense(memory.embed(m, "incident_id", "text", 64), "incident_id", 64).collect()
    assert len(d) == 2 and all(abs(sum(x * x for x in r.embedding) - 1) < 1e-5 for r in d)
    near = memory.nearest(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 1.0])], "id long, v array<double>"), [1.0, 0.1], "id", "v", 2, F.col("id") == 1).collect()
    assert [r.id for r in near] == [2, 3]


def test_sources_and_framing(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"first\r\n\r\n\nsecond\r\nlast without newline\xff")
    got = logs.read_lines(spark, str(tmp_path / "a.log")).collect()
    assert [r.line for r in got] == ["first", "second", "last without newline\ufffd"] and got[0].source_id == "a.log" and [r.ord for r in got] == [0, 10, 18]
    with pytest.raises(ValueError):
        logs.checked(["a", "a"])
    n = logs.counts(logs.merge({"x": logs.read_lines(spark, str(tmp_path / "a.log"))}), ["x", "y"])
    assert {r.source_id: r.n for r in n.collect()} == {"x": 3, "y": 0}
    with pytest.raises(ValueError):
        logs.merge({})


def test_lines_and_places_do_not_depend_on_splits(spark, tmp_path):
    rng = np.random.default_rng(0)
    data = b"".join(bytes(rng.choice(list(b"ab \xc3\xa9\r"), int(rng.integers(0, 40)))) + b"\n" for _ in range(80))
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.log").write_bytes(data)
    (tmp_path / "in" / "sub" / "b.log").write_bytes(data + b"tail")
    (tmp_path / "in" / "_hidden").write_bytes(b"no")
    want, at = [], 0
    for line in (data + b"tail").split(b"\n"):
        if text := line.rstrip(b"\r").decode("utf-8", "replace"):
            want.append((at, text))
        at += len(line) + 1
    spark.dataSource.register(logs.LogSource)
    whole = str(tmp_path / "in")

    def check(got):
        assert sorted((n, line) for source, n, line in got if source == "sub/b.log") == want
        assert sorted((n, line) for source, n, line in got if source == "a.log") == want[:-1] and {source for source, _, _ in got} == {"a.log", "sub/b.log"}

    for split in (1, 7):  # hundreds of ranges: read here, since each would be a task of its own
        files = logs.LogSource({"path": whole, "split": str(split)}).reader(None)
        check([(r["source_id"], r["ord"], r["line"]) for part in files.partitions() for b in files.read(part) for r in b.to_pylist()])
    check([(r.source_id, r.ord, r.line) for r in spark.read.format("log_lines").option("split", 100).load(whole).collect()])
    check([(r.source_id, r.ord, r.line) for r in spark.read.format("log_lines").options(path=whole, split=1 << 20).load().collect()])


def test_stream_of_growing_files_gives_the_batch_events(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    first, more = "2025-03-02 08:00:00 INFO a.b one\n2025-03-02 08:00:01 ERROR a.b tw", "o\n2025-03-02 08:00:02 WARN a.b three\n"

    def drain():
        q = parse(logs.stream_lines(spark, folder, received_at=BASE)).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.parquet(f"{tmp_path}/out").orderBy("timestamp").collect()

    (folder / "a.log").write_text(first)
    assert [r.message for r in drain()] == ["one"]
    (folder / "a.log").write_text(first + more)
    (folder / "b.log").write_text("2025-03-02 08:00:09 INFO a.b other\n")
    got = drain()
    assert [r.message for r in got] == ["one", "two", "three", "other"]
    assert {r.event_id for r in got} == {r.event_id for r in parse(logs.read_lines(spark, folder, received_at=BASE)).collect()}


def test_bounded_batches_of_a_stream(tmp_path):
    path = tmp_path / "a.log"
    path.write_text("".join(f"line {i}\n" for i in range(100)) + "x" * 500 + "\nend")
    tail = logs.LogSource({"path": str(path), "max_bytes": "64"}).streamReader(None)
    offset, seen = tail.initialOffset(), []
    while (after := tail.latestOffset()) != offset:
        batch = [r for part in tail.partitions(offset, after) for b in tail.read(part) for r in b.column("line").to_pylist()]
        assert sum(map(len, batch)) <= 64 or len(batch) == 1
        seen, offset = seen + batch, after
    assert seen == [f"line {i}" for i in range(100)] + ["x" * 500]


def test_a_source_that_fails_is_named(spark, tmp_path):
    (tmp_path / "a.log").write_text("one\ntwo\n")
    good, out = logs.read_lines(spark, tmp_path / "a.log"), f"{tmp_path}/out"
    none = good.filter("line = 'none'")
    assert logs.ingest({"x": good, "y": none}, lambda df: df.write.parquet(out)) == {"x": 2, "y": 0} and spark.read.parquet(out).count() == 2
    bad = good.withColumn("line", F.raise_error(F.lit("gone")).cast("string"))
    with pytest.raises(logs.IngestionError, match="bad"):
        logs.ingest({"good": good, "bad": bad}, lambda df: df.write.mode("overwrite").format("noop").save())


def test_repository_tools(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git/x.py").write_text("def foo(): pass\n")
    (tmp_path / "src/m.py").write_text("import os\n\n\nasync def foo(x):\n    return 'A.b'\n")
    root = str(tmp_path)
    assert [r.path for r in repo.list_files(spark, root, "*.py").collect()] == ["src/m.py"]
    assert [(r.path, r.line) for r in repo.search(spark, root, "a.B").collect()] == [("src/m.py", 5)]
    assert [(r.line) for r in repo.find_symbol(spark, root, "foo").collect()] == [4]
    assert [r.text for r in repo.read_lines(spark, root, "src/m.py", 4, 4).collect()] == ["    4 | async def foo(x):"]
    (tmp_path / "big.py").write_text("x = 1\n" * 200_000)
    with pytest.raises(ValueError):
        repo.read_lines(spark, root, "big.py")
    with pytest.raises(ValueError):
        repo.history(spark, root + "/src")
    for bad in ("", "/etc/passwd", "../x", "a/../../b"):
        with pytest.raises(ValueError):
            repo.inside(bad)


def test_sinks(spark, tmp_path):
    root = str(tmp_path)
    e = make(spark, steady([3, 3]) + [(5, "b", 40, "generic", "other", None)])
    tables.write_events(e.filter("service = 'a'"), root)
    tables.write_events(e.filter("service = 'b'"), root)
    assert tables.read_events(spark, root).count() == 7 and spark.read.parquet(f"{root}/event_signatures").count() == 2
    src = spark.createDataFrame([("x", "plain"), ("x", "plain")], "source_id string, log_format string")
    tables.register_sources(src, root)
    tables.register_sources(src, root)
    assert spark.read.parquet(f"{root}/log_sources").count() == 1
    tables.write_events(e, root)
    tables.write_events(e.union(e), root)
    assert tables.read_events(spark, root).count() == 7 and [r.source_id for r in tables.sources(spark, root).collect()] == ["x"]
    e.withColumn("event_id", F.concat(F.lit("s"), "event_id")).write.parquet(f"{root}/in")
    for _ in range(2):
        tables.stream_events(spark.readStream.schema(EVENT).parquet(f"{root}/in"), root, f"{root}/cp").awaitTermination()
    assert tables.read_events(spark, root).select("event_id").distinct().count() == tables.read_events(spark, root).count() == 14


def test_incident_tables(spark, tmp_path):
    root = str(tmp_path)
    for unknown in (lambda: tables.set_status(spark, root, "i", "analyzing"), lambda: tables.incident(spark, root, "i")):
        with pytest.raises(KeyError):
            unknown()
    tables.create_incident(spark, root, "i", BASE, BASE + timedelta(minutes=1))
    tables.create_incident(spark, root, "j", BASE, BASE)
    tables.set_status(spark, root, "i", "completed", "done")
    clusters = spark.createDataFrame([("k", 1)], "kind string, n int")
    edges = spark.createDataFrame([("a", "b", 0.5)], "source_event string, target_event string, composite_score double")
    tables.attach_analysis(root, "i", clusters, edges, BASE, BASE + timedelta(minutes=2))
    r = tables.incident(spark, root, "i")
    assert (r.status, r.summary, r.seq, r.window_end - r.window_start) == ("completed", "done", 2, timedelta(minutes=2))
    assert tables.edges_of(spark, root, "i").count() == 1 and [x.incident_id for x in tables.recent_incidents(spark, root).collect()] == ["j", "i"] and tables.recent_incidents(spark, root, 1).count() == 1
    with pytest.raises(KeyError):
        tables.attach_analysis(root, "z", clusters, edges, BASE, BASE)
    with pytest.raises(ValueError):
        tables.set_status(spark, root, "i", "lost")
    audit = spark.createDataFrame([("a", "t", "{}", "ok", "", 1.0)], "agent string, tool string, arguments string, outcome string, detail string, duration_ms double")
    result = {"status": "completed", "findings": [{"agent": "a", "finding": {"x": 1}}], "verdict": {"cause": "c"}, "patch": {"diff": ""}}
    tables.persist_investigation(spark, root, "v1", "i", result, audit)
    assert tables.latest_investigation(spark, root, "i").first().investigation_id == "v1"
    assert all(spark.read.parquet(f"{root}/{t}").filter("investigation_id = 'v1'").count() == 1 for t in ("agent_findings", "tool_executions", "patch_proposals"))
    m = spark.createDataFrame([("i", "text")], "incident_id string, text string")
    assert [[r.outcome for r in tables.remember_once(m, root).collect()] for _ in range(2)] == [["stored"], ["duplicate"]]


def test_embedders(spark):
    df = spark.createDataFrame([("a", "pool full"), ("b", None), ("c", "disk")], "id string, text string")
    made = memory.build_embedder("remote", call=lambda texts: [[float(len(t)), 1.0] for t in texts])(df, "id", "text")
    assert {r.id: r.embedding for r in made.collect()} == {"a": [9.0, 1.0], "b": [0.0, 1.0], "c": [4.0, 1.0]}
    assert memory.build_embedder(dim=8)(df, "id", "text").count() == 2
    with pytest.raises(ValueError):
        memory.build_embedder("other")


def test_recall_by_blocks_equals_all_pairs(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(30)]
    m = [(i, " ".join(rng.choice(words, 6))) for i in range(120)] + [(200 + i, "w1 w2 w3") for i in range(5)]
    q = [(f"q{i}", " ".join(rng.choice(words, 5)), int(rng.integers(0, 120)) if i % 2 else None) for i in range(25)] + [("q99", "w1 w2 w3", 201)]
    mem, ask = spark.createDataFrame(m, "doc long, text string").repartition(5), spark.createDataFrame(q, "question string, text string, exclude long")
    vectors = {r.doc: np.array(r.embedding) for r in memory.dense(memory.embed(mem, "doc", "text"), "doc").collect()}
    asked = {r.question: np.array(r.embedding) for r in memory.dense(memory.embed(ask, "question", "text"), "question").collect()}
    want = {}
    for name, _, without in q:
        best = sorted((-round(float(asked[name] @ v), 5), d) for d, v in vectors.items() if d != without)[:3]
        want |= {(name, d): -s for s, d in best if -s >= 0.3}
    for block in (1000, 7):
        got = {(r.question, r.doc): r.similarity for r in memory.similar(mem, ask, "doc", block=block).collect()}
        assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x], abs=1e-4) for x in got)


def test_metrics_of_a_stream(spark, tmp_path):
    from kestrelog.streaming.metrics import Metrics, observed

    make(spark, steady([3, 4]) + [(5, "b", 40, "generic", "x", None)]).write.parquet(f"{tmp_path}/in")
    listener = Metrics()
    spark.streams.addListener(listener)
    try:
        stream = observed(spark.readStream.schema(EVENT).parquet(f"{tmp_path}/in"), "parsed", "service", ("a", "b"))
        stream.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
        for _ in range(100):
            if listener.totals["ended"]:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert (listener.totals["parsed.total"], listener.totals["parsed.a"], listener.totals["parsed.b"]) == (8, 7, 1)


def test_new_signatures_of_a_stream(spark, tmp_path):
    rows = [(i, "a", 20, "generic", "known", None) for i in range(5)] + [(100 + i, "a", 40, "generic", "new", None) for i in range(3)] + [(101, "a", 40, "generic", "known", None), (102, "b", 20, "generic", "mild", None), (103, "b", 40, "generic", "mild", None)]
    make(spark, rows).repartition(1).write.parquet(f"{tmp_path}/in/0")
    make(spark, [(500, "c", 20, "generic", "beat", None)]).repartition(1).write.parquet(f"{tmp_path}/in/1")
    early = streaming.learned_until(make(spark, rows), 5)
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = streaming.new_signatures(stream, early).writeStream.format("memory").queryName("fresh").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    want = detect.new_signatures(make(spark, rows), detect.Settings(learning=5)).collect()
    key = lambda r: (r.service, r.key, r.event_count, r.window_start, r.window_end, tuple(r.representative_events), round(r.confidence, 9))
    assert list(map(key, spark.table("fresh").collect())) == list(map(key, want)) and len(want) == 1


@pytest.fixture(scope="module")
def incident(spark, tmp_path_factory):
    files = logs.synthetic_incident(str(tmp_path_factory.mktemp("incident")))
    e = settled(parse(logs.read_incident(spark, files, BASE)), "events")
    deps = spark.createDataFrame(logs.DEPENDENCIES, "service string, dependency string")
    return e, deps, evidence.analyse(e, deps, detect.Settings(learning=400))


def test_incident_end_to_end(spark, incident):
    e, deps, a = incident
    assert e.count() == sum(act[1] for act in logs.ACTS) and {r.service for r in e.select("service").distinct().collect()} == set(logs.WRITERS)
    assert e.filter("trace_id is not null").count() > 700 and e.filter("timestamp < '2025-03-02 08:00:00' or timestamp > '2025-03-02 08:10:00'").count() == 0
    kinds = {(r.kind, r.service) for r in a.clusters.collect()}
    assert {k for k, _ in kinds} == {"frequency_spike", "new_signature", "error_ratio", "retry_storm"} and ("retry_storm", "mailer") in kinds
    b = evidence.bundle(a)
    assert 50 < a.edges.count() and 100 < a.vertices.count() < 900
    assert b.candidates[0][1].service in ("stock", "ledger", "gate")
    text = evidence.render(b)
    assert "Root candidates:" in text and "retry_storm" in text


def test_tools(spark, incident):
    e, deps, a = incident
    r = tools.registry(spark, e, a.clusters, deps)
    r.seconds = 120
    rate = r.call("calculate_error_rate", {"service": "stock", "start": "2025-03-02T08:00:00", "end": "2025-03-02T08:10:00"})
    assert sum(x["errors"] for x in rate) == 30 and sum(x["total"] for x in rate) == 190
    assert len(r.call("search_events", {"query": "TOO MANY CONNECTIONS", "limit": 5})) == 5
    assert {x["service"] for x in r.call("analyze_db_connections", {"start": "2025-03-02T08:00:00", "end": "2025-03-02T08:10:00"})} == {"ledger"}
    assert r.call("inspect_dependency_graph", {"service": "stock"})[0]["depended_on_by"] == ["gate", "mailer"]
    for bad in ({"query": "x"}, {"query": "xx", "limit": 101}, {"query": "xx", "more": 1}, {}):
        with pytest.raises(ValueError):
            r.call("search_events", bad)
    found = tools.ScriptedAgent("log_analyst", [("search_events", {"query": "upstream"}), ("nothing", {}), {"cause": "cache"}]).investigate(r)
    assert found["finding"] == {"cause": "cache"} and r.audited(spark).filter("outcome = 'error'").count() == 5
    assert tools.first_object('so {"a": {"b": 1}} end') == {"a": {"b": 1}} and tools.first_object("none") is None
    r.rows = 3
    with pytest.raises(ValueError, match="more than 3"):
        r.call("search_events", {"query": "upstream"})
    slow = tools.Registry(seconds=0.5)
    slow.add(tools.Tool("wait", {}, lambda: spark.range(1).select(F.udf(lambda x: time.sleep(20))("id"))))
    with pytest.raises(TimeoutError):
        slow.call("wait", {})
    assert slow.audit[0]["outcome"] == "timeout"


def test_patches():
    good = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1 +1 @@\n-a\n+b\n"
    assert tools.patch_problems(good, {"x.py"}) == [] and tools.patch_problems("--- /dev/null\n+++ b/x.py\n", {"x.py"}) == []
    for diff in ("", "words"):
        assert tools.patch_problems(diff, set()) == ["no files"]
    for diff in ("diff --git a/x.py b/y.py\n", "+++ y.py\n--- a/x.py\n", "--- a/x.py\n+++ b/x.py\nrename to y.py\n", "+++\ty.py\n--- x.py"):
        assert tools.patch_problems(diff, {"x.py"}) == ["not declared: y.py"], diff
    assert tools.patch_problems(good, {"x.py", "../../etc/passwd"}) == ["outside: ../../etc/passwd"]
    assert tools.patch_problems("--- a/../x.py\n", {"../x.py"}) == ["outside: ../x.py"] and "outside: /etc/x" in tools.patch_problems("--- /etc/x\n", {"/etc/x"})


def test_agents():
    registry = tools.Registry()
    say = lambda x: {"text": f"so: {x}"}
    agent = lambda name, *replies, **more: agents.Agent(name, agents.scripted(replies), **more)
    assert agent("a", say("none"), say('{"cause": 1}'), needs=("cause",)).run("t", registry)["finding"] == {"cause": 1}
    assert agent("a", say("none"), say('{"other": 1}'), say('{"cause": 1}'), needs=("cause",)).run("t", registry)["finding"] is None
    greedy = agent("a", *[{"tool": "x"}] * 10, say("{}"))
    assert greedy.run("t", registry) == {"agent": "a", "finding": {}, "calls": 8} and len(registry.audit) == 8
    assert agent("a", *[{"tool": "x"}] * 20).run("t", registry)["finding"] is None
    steps = []
    plan = agents.Investigation([agent("s1", say('{"a": 1}')), agent("s2")], agent("adv", say('{"b": 2}')), agent("cmd", say('{"c": 3}')), agent("patch", say('{"diff": "d"}')))
    out = plan.run("evidence", registry, lambda share, step: steps.append(share))
    assert out["status"] == "completed" and out["verdict"] == {"c": 3} and out["patch"] == {"diff": "d"} and [f["finding"] for f in out["findings"]] == [{"a": 1}, None, {"b": 2}, {"c": 3}]
    assert steps == sorted(steps) and (steps[0], steps[-1]) == (0.0, 1.0)


def test_persistent_models():
    def flaky(times, error=ConnectionError):
        left = [times]

        def model(talk):
            left[0] -= 1
            if left[0] >= 0:
                raise error("busy")
            return {"text": "ok"}

        return model

    waits = []
    assert agents.persistent(flaky(3), sleep=waits.append)([]) == {"text": "ok"} and len(waits) == 3 and all(0 <= w <= 0.5 * 2**n for n, w in enumerate(waits))
    with pytest.raises(ConnectionError):
        agents.persistent(flaky(4), sleep=waits.append)([])
    with pytest.raises(KeyError):
        agents.persistent(flaky(1, KeyError), sleep=waits.append)([])
    budget = agents.Retries(1)
    with pytest.raises(ConnectionError):
        agents.persistent(flaky(2), budget=budget, sleep=waits.append)([])
    with pytest.raises(ValueError):
        agents.persistent(flaky(1), tries=0)


def test_entry_and_oracles(spark):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    con, queries = duckdb.connect(), entry.queries()
    for t in ("nation", "region", "orders", "events", "documents", "embeddings", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    for name, sql in entry.oracle_sql().items():
        got = queries[name](spark, "/root/testdata/sf0.001").toPandas()
        want = con.execute(sql).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns), name
        # whole numbers with nulls come in another type from each side
        a, b = (x[columns].convert_dtypes().astype(str).sort_values(columns).reset_index(drop=True) for x in (got, want))
        assert a.equals(b), name
