"""Files that rotate, tables written by several writers, globs, and streams of new templates."""

import json
import os
import shutil
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kestrelog.operators import query
from kestrelog.operators.detect import Settings
from kestrelog.schema import EVENT
from kestrelog.sinks import tables
from kestrelog.sources import logs, repo
from kestrelog.streaming import detect as stream

BASE = datetime(2026, 7, 6, 14, 0, tzinfo=UTC)


def event_rows(spark, n):
    data = [(f"e{i}", BASE + timedelta(seconds=i), "a", "src", 20, "generic", f"t{i % 2}", f"t{i % 2}", f"t{i % 2}", None, None, None, None, i) for i in range(n)]
    return spark.createDataFrame(data, EVENT)


class Reader:
    """The stream as Spark drives it: offsets, partitions, commits, restarts."""

    def __init__(self, path, **options):
        self.options, self.got = {"path": str(path)} | options, []
        self.tail = logs.LogSource(self.options).streamReader(None)
        self.at = self.tail.initialOffset()

    def restart(self):
        self.tail = logs.LogSource(self.options).streamReader(None)

    def step(self, read=True):
        """The lines of one batch; without ``read`` only what Spark would log before it runs one."""
        end = json.loads(json.dumps(self.tail.latestOffset()))
        if read:
            return self.run(end)
        return end

    def run(self, end):
        rows = [r for part in self.tail.partitions(self.at, end) for batch in self.tail.read(part) for r in batch.to_pylist()]
        self.at = end
        self.tail.commit(end)
        self.got += [(r["source_id"], r["ord"], r["line"]) for r in rows]
        return [r["line"] for r in rows]


def write(path, *lines, mode="a"):
    with open(path, mode) as f:
        f.writelines(f"{line}\n" for line in lines)


def test_a_renamed_file_goes_on_under_its_name(tmp_path):
    log = tmp_path / "app.log"
    write(log, "one", "two")
    r = Reader(tmp_path)
    assert r.step() == ["one", "two"]
    write(log, "three")
    log.rename(tmp_path / "app.log.1")
    write(log, "a", "b", "c", "d", "e")
    assert sorted(r.step()) == ["a", "b", "c", "d", "e", "three"] and r.step() == []
    assert {s for s, _, _ in r.got} == {"app.log"} and len({o for _, o, _ in r.got}) == 8
    (tmp_path / "app.log.1").rename(tmp_path / "app.log.2")
    log.rename(tmp_path / "app.log.1")
    write(tmp_path / "app.log.1", "f")
    write(log, "x")
    assert sorted(r.step()) == ["f", "x"] and len({o for _, o, _ in r.got}) == 10


def test_a_file_copied_and_cut_loses_and_repeats_nothing(tmp_path):
    log = tmp_path / "app.log"
    write(log, "one", "two")
    r = Reader(tmp_path)
    assert r.step() == ["one", "two"]
    write(log, "three")
    shutil.copy(log, tmp_path / "app.log.1")
    write(log, "a", mode="w")  # the same inode, shorter
    assert sorted(r.step()) == ["a", "three"]
    shutil.copy(log, tmp_path / "app.log.2")
    write(log, "a much longer file than before", "b", mode="w")  # the same inode, longer, another beginning
    assert r.step() == ["a much longer file than before", "b"]
    assert [line for _, _, line in sorted(r.got)] == ["one", "two", "three", "a", "a much longer file than before", "b"]


def test_lines_that_are_gone_are_an_error(tmp_path):
    write(tmp_path / "a.log", "one")
    write(tmp_path / "b.log", "one")
    r = Reader(tmp_path)
    assert r.step() == ["one", "one"]
    write(tmp_path / "a.log", "two")
    end = r.step(read=False)
    os.remove(tmp_path / "a.log")
    with pytest.raises(ValueError, match="a.log"):
        r.run(end)
    os.remove(tmp_path / "b.log")
    quiet = Reader(tmp_path)
    assert quiet.step() == [] and quiet.tail.latestOffset()["files"] == {}  # what was read to its end may go


def test_a_restart_knows_files_and_bounds_again(tmp_path):
    logs_, progress = tmp_path / "logs", tmp_path / "progress"
    logs_.mkdir()
    write(logs_ / "app.log", *[f"line {i}" for i in range(10)])
    r = Reader(logs_, progress=str(progress), max_bytes="30")
    while r.step():
        pass
    r.restart()
    write(logs_ / "app.log", *[f"more {i}" for i in range(20)])
    (logs_ / "app.log").rename(logs_ / "app.log.1")
    write(logs_ / "app.log", "new")
    assert 0 < len(r.step()) <= 4
    while r.step():
        pass
    assert sorted(line for _, _, line in r.got) == sorted([f"line {i}" for i in range(10)] + [f"more {i}" for i in range(20)] + ["new"])
    bare = Reader(logs_)
    bare.step()
    bare.restart()
    write(logs_ / "app.log", "other", mode="w")
    with pytest.raises(ValueError, match="progress"):
        bare.step()


def test_a_stream_over_rotations(spark, tmp_path):
    """Through Spark itself, in three runs."""
    folder, out = tmp_path / "logs", tmp_path / "out"
    folder.mkdir()

    def run():
        df = logs.stream_lines(spark, folder, progress=str(tmp_path / "progress"))
        df.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.line for r in spark.read.parquet(str(out)).collect())

    write(folder / "app.log", "one", "two")
    assert run() == ["one", "two"]
    write(folder / "app.log", "three")
    (folder / "app.log").rename(folder / "app.log.1")
    write(folder / "app.log", "a")
    assert run() == ["a", "one", "three", "two"]
    write(folder / "app.log", "b", mode="w")
    assert run() == ["a", "b", "one", "three", "two"]


def test_events_are_written_once_whoever_writes_them(spark, tmp_path):
    root, rows = str(tmp_path / "t"), event_rows(spark, 3)
    tables.write_events(rows, root)
    source = str(tmp_path / "in")
    event_rows(spark, 5).write.parquet(source)
    tables.stream_events(spark.readStream.schema(rows.schema).parquet(source), root, str(tmp_path / "cp")).awaitTermination()
    tables.write_events(event_rows(spark, 6), root)
    got = [r.event_id for r in tables.read_events(spark, root).collect()]
    assert sorted(got) == sorted(r.event_id for r in event_rows(spark, 6).collect())
    spark.read.parquet(f"{root}/event_signatures").limit(1).write.mode("append").parquet(f"{root}/event_signatures")  # two writers at once
    assert tables.read_events(spark, root).count() == 6


def test_ranges_read_their_dates_alone(spark, tmp_path):
    root = str(tmp_path / "t")
    rows = event_rows(spark, 3)
    for day in range(3):
        tables.write_events(rows.withColumn("timestamp", F.col("timestamp") + F.expr(f"interval {day} days")).withColumn("event_id", F.concat("event_id", F.lit(f"-{day}"))), root)
    day = timedelta(days=1)
    for found in (tables.read_events(spark, root, BASE + day, BASE + day + timedelta(hours=1)), query.window(tables.read_events(spark, root), BASE + day, BASE + day + timedelta(hours=1))):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(event_date" in plan and "event_date" in plan.split("PartitionFilters:")[1][:200]
        assert found.count() == 3 and len([f for f in found.inputFiles() if "event_date" in f]) >= 1


def test_what_a_writer_left_behind_is_never_seen(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    clusters = spark.createDataFrame([("frequency_spike", 3)], "kind string, event_count int")
    edges = spark.createDataFrame([("a", "b", 0.5)], "source_event string, target_event string, composite_score double")
    tables.create_incident(spark, root, "i", BASE, BASE)
    tables.attach_analysis(root, "i", clusters, edges, BASE, BASE)
    real = tables._state
    monkeypatch.setattr(tables, "_state", lambda *a: (_ for _ in ()).throw(OSError("died")))
    with pytest.raises(OSError):
        tables.attach_analysis(root, "i", clusters, edges.union(edges), BASE, BASE)
    assert tables.edges_of(spark, root, "i").count() == 1 and tables.clusters_of(spark, root, "i").count() == 1
    monkeypatch.setattr(tables, "_state", real)
    tables.attach_analysis(root, "i", clusters, edges.union(edges).union(edges), BASE, BASE)
    tables.set_status(spark, root, "i", "completed")
    assert tables.edges_of(spark, root, "i").count() == 3 and tables.incident(spark, root, "i").status == "completed"
    audit = spark.createDataFrame([("search", 1.0)], "tool string, duration_ms double")
    result = {"findings": [{"agent": "a", "finding": {"x": 1}}], "status": "completed", "verdict": {}, "patch": None}
    real_append = tables.append
    monkeypatch.setattr(tables, "append", lambda df, root, name: real_append(df, root, name) if name != "investigations" else (_ for _ in ()).throw(OSError("died")))
    with pytest.raises(OSError):
        tables.persist_investigation(spark, root, "v", "i", result, audit)
    monkeypatch.setattr(tables, "append", real_append)
    tables.persist_investigation(spark, root, "v", "i", result, audit)
    assert tables.parts_of(spark, root, "v").count() == 1 and tables.parts_of(spark, root, "v", "tool_executions").count() == 1


def test_globs_of_paths(spark, tmp_path):
    for name in ("a.py", "src/b.py", "src/deep/c.py", "src/deep/d.txt", ".git/e.py", "src/x[1].py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("def f(): pass\n")
    listed = lambda glob: [r.path for r in repo.list_files(spark, str(tmp_path), glob).collect()]
    assert listed("**/*.py") == listed("*.py") == ["a.py", "src/b.py", "src/deep/c.py", "src/x[1].py"]
    assert listed("src/*.py") == ["src/b.py", "src/x[1].py"] and listed("src/**") == ["src/b.py", "src/deep/c.py", "src/deep/d.txt", "src/x[1].py"]
    assert listed("src/**/[c-d].*") == ["src/deep/c.py", "src/deep/d.txt"] and listed("src/?.py") == ["src/b.py"] and listed("[!a].py") == ["src/b.py", "src/deep/c.py"]
    assert len(repo.search(spark, str(tmp_path), "def f", "src/**/*.py").collect()) == 3
    with pytest.raises(ValueError, match="pattern"):
        repo.search(spark, str(tmp_path), "(", regex=True)


def test_representatives_of_a_stream_stay_in_the_window(spark, tmp_path):
    """One event, three after its window, and later ones that let the watermark pass."""
    rows = event_rows(spark, 1).withColumn("severity", F.lit(40)).drop("timestamp", "event_id", "ord")
    at = [0, 12, 13, 15, 400]
    e = rows.crossJoin(spark.createDataFrame([(f"e{t}", BASE + timedelta(seconds=t), t) for t in at], "event_id string, timestamp timestamp, ord long"))
    source = str(tmp_path / "in")
    e.filter("event_id <> 'e400'").coalesce(1).write.parquet(source + "/1")
    e.filter("event_id = 'e400'").coalesce(1).write.parquet(source + "/2")
    found = stream.new_signatures(spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(source), BASE - timedelta(days=1), Settings(seconds=10), "1 second")
    q = found.writeStream.format("memory").queryName("d4").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("d4").filter("event_count > 0").collect()
    assert (got[0].event_count, list(got[0].representative_events)) == (1, ["e0"])
