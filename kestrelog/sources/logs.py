"""Log files as raw records, batch and streaming, and their merge."""

from __future__ import annotations

import hashlib
import io
import json
import os
import random
from collections.abc import Callable, Iterable, Iterator
from datetime import UTC, datetime, timedelta
from functools import reduce
from pathlib import Path

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


class LogSource(DataSource):
    """Files of lines by byte ranges: ``spark.read`` or ``readStream`` ``.format("log_lines")``.

    ``ord`` is the byte at which a line begins in its file, so a line has the same source and place, and its
    event the same id, in every run, with any splits, in batch and as a stream. Options: path (a file or a
    folder, any file system that pyarrow knows), source_id (else the file's path below the folder, or its
    name), log_format, received_at (ISO; else now), split (bytes a task), max_bytes (a stream's bytes a
    batch; without it a batch takes all there is). Names that begin with a dot or an underscore are no logs.

    As a stream, files may grow, be renamed, be copied and cut, and new ones may come; a line counts once its
    line feed is there. A file is known by its inode, where the file system has one, and by a hash of its first
    bytes. A renamed one goes on under its first name; one that shrinks or begins otherwise is a new generation of
    its name, with places from ``generation << 44`` on, and what was left of the old one is read where it is now.
    Lines that are gone before they were read are an error. ``progress`` names a folder in which the source keeps
    where it stands, so that the first batch after a restart is bounded, too, and knows all files again; without
    it a file that was rotated while the stream was down is an error.
    """

    @classmethod
    def name(cls) -> str:
        return "log_lines"

    def schema(self) -> str:
        return "source_id string, line string, received_at timestamp, log_format string, ord long"

    def reader(self, schema) -> _Files:
        return _Files(self.options)

    def streamReader(self, schema) -> _Tail:
        return _Tail(self.options)


class _Lines(InputPartition):
    def __init__(self, path: str, source_id: str, start: int, end: int, base: int = 0):
        super().__init__((path, start, end))
        self.path, self.source_id, self.start, self.end, self.base = path, source_id, start, end, base


class _Files(DataSourceReader):
    def __init__(self, options):
        self.path, self.source_id, self.log_format = options["path"], options.get("source_id"), options.get("log_format", "plain")
        self.received_at, self.split = options.get("received_at"), int(options.get("split", 64 << 20))

    def opened(self) -> tuple[fs.FileSystem, str]:
        if "://" in self.path or self.path.startswith("file:"):
            return fs.FileSystem.from_uri(self.path)
        return fs.LocalFileSystem(), self.path

    def sizes(self) -> dict[str, int]:
        system, path = self.opened()
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.type == fs.FileType.File:
            return {path: info.size}
        found = system.get_file_info(fs.FileSelector(path, recursive=True))
        out = {f.path: f.size for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))}
        if self.source_id is not None and len(out) > 1:
            raise ValueError(f"{self.path}: one source id for {len(out)} files")
        return out

    def named(self, path: str) -> str:
        if self.source_id is not None:
            return self.source_id
        _, root = self.opened()
        return path.rpartition("/")[2] if path == root else path.removeprefix(root.rstrip("/")).lstrip("/")

    def cut(self, path: str, start: int, end: int, name: str | None = None, base: int = 0) -> list[_Lines]:
        name = self.named(path) if name is None else name
        return [_Lines(path, name, at, min(at + self.split, end), base) for at in range(start, end, self.split)]

    def partitions(self) -> list[_Lines]:
        return [part for path, size in sorted(self.sizes().items()) for part in self.cut(path, 0, size)] or [_Lines("", "", 0, 0)]

    def read(self, part: _Lines) -> Iterator[pa.RecordBatch]:
        """The lines that begin in the range, without carriage returns at their ends; empty ones go."""
        at = datetime.fromisoformat(self.received_at) if self.received_at else datetime.now(UTC)
        kinds = [pa.string(), pa.string(), pa.timestamp("us", "UTC"), pa.string(), pa.int64()]

        def batch(rows):
            columns = [[part.source_id] * len(rows), [line for _, line in rows], [at] * len(rows), [self.log_format] * len(rows), [part.base + n for n, _ in rows]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["source_id", "line", "received_at", "log_format", "ord"])

        rows: list[tuple[int, str]] = []
        if part.start < part.end:
            system, _ = self.opened()
            with system.open_input_file(part.path) as raw, io.BufferedReader(raw, min(1 << 20, max(1 << 12, part.end - part.start))) as file:
                place = max(0, part.start - 1)
                file.seek(place)
                if part.start:
                    place += len(file.readline())  # the rest of a line that begins before
                while place < part.end and (line := file.readline()):
                    if text := line.removesuffix(b"\n").rstrip(b"\r").decode("utf-8", "replace"):
                        rows.append((place, text))
                    place += len(line)
                    if len(rows) == 10_000:
                        yield batch(rows)
                        rows = []
        yield batch(rows)


#: First bytes of a file by whose hash it is known, and bits of a place below the generation.
HEAD, PLACES = 1024, 44


class _Tail(_Files, DataSourceStreamReader):
    """Offsets: for each file at hand its name, generation, the bytes read up to a line feed, inode, and the
    hash of its first bytes; and the last generation of each name."""

    def __init__(self, options):
        super().__init__(options)
        self.most, self.progress, self.done = int(options.get("max_bytes", 0)), options.get("progress"), None

    def initialOffset(self) -> dict:
        self.done = {"files": {}, "names": {}}
        return self.done

    def _stored(self) -> tuple[fs.FileSystem, str]:
        system, folder = fs.FileSystem.from_uri(self.progress) if "://" in self.progress or self.progress.startswith("file:") else (fs.LocalFileSystem(), self.progress)
        return system, f"{folder.rstrip('/')}/offset.json"

    def commit(self, end: dict) -> None:
        if self.progress:
            system, name = self._stored()
            system.create_dir(name.rpartition("/")[0], recursive=True)
            with system.open_output_stream(name + ".new") as out:
                out.write(json.dumps(end).encode())
            system.move(name + ".new", name)

    def _restored(self) -> dict | None:
        if not self.progress:
            return None
        system, name = self._stored()
        if system.get_file_info(name).type != fs.FileType.File:
            return None
        with system.open_input_stream(name) as file:
            return json.loads(file.read())

    def _head(self, path: str, n: int) -> str:
        system, _ = self.opened()
        with system.open_input_file(path) as file:
            return hashlib.sha256(file.read(n)).hexdigest()[:32] if n else ""

    def _inode(self, path: str) -> int:
        return os.stat(path).st_ino if isinstance(self.opened()[0], fs.LocalFileSystem) else 0

    def _begins(self, path: str, size: int, e: dict) -> bool:
        return size >= e["end"] and self._head(path, e["n"]) == e["head"]

    def _whole(self, path: str, size: int, least: int) -> int:
        """Where the last whole line ends."""
        system, _ = self.opened()
        with system.open_input_file(path) as file:
            end = size
            while end > least:
                begin = max(least, end - (1 << 16))
                file.seek(begin)
                found = file.read(end - begin).rfind(b"\n")
                if found >= 0:
                    return begin + found + 1
                end = begin
        return least

    def _found(self, sizes: dict[str, int], known: dict, names: dict) -> dict:
        """The entry of each file at hand; those that have moved keep theirs, new ones start at 0."""
        inodes = {path: self._inode(path) for path in sizes}
        out = {p: e for p, e in known.items() if p in sizes and e["ino"] == inodes[p] and self._begins(p, sizes[p], e)}
        for p, e in known.items():
            if p in out:
                continue
            free = [q for q in sizes if q not in out and q != p and self._begins(q, sizes[q], e)]
            same = [q for q in free if e["ino"] and inodes[q] == e["ino"]]
            # a copy is known by its first bytes, if the file itself was cut; without inodes there is nothing else
            copied = free if e["n"] and (not e["ino"] or inodes.get(p) == e["ino"]) else []
            if same or copied:
                out[(same or copied)[0]] = e
            elif p not in sizes and e["end"] < e["size"]:
                raise ValueError(f"{e['name']}: gone with {e['size'] - e['end']} bytes unread")
        for p in sorted(sizes.keys() - out.keys()):
            name = self.named(p)
            names[name] = names.get(name, -1) + 1
            out[p] = {"name": name, "gen": names[name], "end": 0, "n": 0, "head": ""}
        return {p: e | {"ino": inodes[p], "size": sizes[p]} for p, e in out.items()}

    def latestOffset(self) -> dict:
        done = self.done if self.done is not None else self._restored()
        sizes, names = self.sizes(), dict((done or {}).get("names", {}))
        found, room = self._found(sizes, (done or {}).get("files", {}), names), self.most
        for path, e in sorted(found.items()):
            size, old = sizes[path], e["end"]
            limit = min(size, old + room) if self.most and done is not None else size
            end = self._whole(path, limit, old) if limit > old else old
            if end == old < size and limit < size and room == self.most:
                end = self._whole(path, size, old)  # a line longer than the bound comes whole
            e["end"], e["n"] = end, min(end, HEAD)
            e["head"] = self._head(path, e["n"])
            room = max(0, room - (end - old))
        return {"files": found, "names": names}

    def partitions(self, start: dict, end: dict) -> list[_Lines]:
        self.done = end
        begun = {(e["name"], e["gen"]): e for e in start.get("files", {}).values()}
        sizes, parts = None, []
        for path, e in sorted(end["files"].items()):
            old = begun.get((e["name"], e["gen"]), {"end": 0, "n": 0, "head": ""})
            if old["end"] == e["end"] and old["head"] == e["head"]:
                continue
            sizes = self.sizes() if sizes is None else sizes
            where = next((q for q in [path, *sizes] if q in sizes and self._begins(q, sizes[q], e)), None)
            if where is None or self._head(where, old["n"]) != old["head"]:
                raise ValueError(f"{e['name']}: bytes {old['end']} to {e['end']} are gone" if where is None else f"{e['name']}: another file than before the stream stopped; name a progress folder")
            parts += self.cut(where, old["end"], e["end"], e["name"], e["gen"] << PLACES)
        return parts


def _load(reader, spark: SparkSession, path, source_id, log_format, received_at, **more) -> DataFrame:
    spark.dataSource.register(LogSource)
    options = {"path": str(path), "source_id": source_id, "log_format": log_format, "received_at": received_at.isoformat() if received_at else None} | more
    return reader.format("log_lines").options(**{k: v for k, v in options.items() if v is not None}).load()


def read_lines(spark: SparkSession, path, source_id: str | None = None, log_format: str = "plain", received_at: datetime | None = None) -> DataFrame:
    """Lines of a file or of all files of a folder, cut at line feeds alone."""
    return _load(spark.read, spark, path, source_id, log_format, received_at)


def read_json_lines(spark: SparkSession, path, source_id: str | None = None, received_at: datetime | None = None) -> DataFrame:
    return read_lines(spark, path, source_id, "json", received_at)


def read_container(spark: SparkSession, path, container: str, received_at: datetime | None = None) -> DataFrame:
    return read_lines(spark, path, f"docker:{container}", "docker_json", received_at)


def stream_lines(spark: SparkSession, path, source_id: str | None = None, log_format: str = "plain", received_at: datetime | None = None, max_bytes: int | None = None, progress: str | None = None) -> DataFrame:
    """New lines of files that grow, rotate or come, as a stream; ``max_bytes`` a batch bounds what is in flight,
    after a restart too if the source may keep where it stands in the folder ``progress``."""
    return _load(spark.readStream, spark, path, source_id, log_format, received_at, max_bytes=max_bytes, progress=progress)


class IngestionError(RuntimeError):
    """A source that couldn't be read, by its name."""

    def __init__(self, source_id: str):
        super().__init__(f"source {source_id} failed")
        self.source_id = source_id


def ingest(sources: dict[str, DataFrame], write: Callable[[DataFrame], None]) -> dict[str, int]:
    """Write the bag of all sources; records by source, counted on the way. The first source that can't be
    read fails the whole with its name."""
    parts, seen = [], {name: Observation(f"source-{i}") for i, name in enumerate(checked(sources))}
    for name, df in sources.items():
        parts.append(df.withColumn("source_id", F.lit(name)).observe(seen[name], F.count(F.lit(1)).alias("n")))
    if not parts:
        raise ValueError("no sources")
    try:
        write(reduce(DataFrame.unionByName, parts))
    except Exception as error:
        for name, df in sources.items():
            try:
                df.write.format("noop").mode("overwrite").save()
            except Exception:
                raise IngestionError(name) from error
        raise
    return {name: int(found.get["n"]) for name, found in seen.items()}


def merge(sources: dict[str, DataFrame]) -> DataFrame:
    """The bag of all sources' records."""
    if not sources:
        raise ValueError("no sources")
    return reduce(DataFrame.unionByName, [df.withColumn("source_id", F.lit(name)) for name, df in sources.items()])


def checked(names: Iterable[str]) -> list[str]:
    """The names; repeated ones are an error."""
    names = list(names)
    if len(set(names)) < len(names):
        raise ValueError(f"sources with one name: {sorted({n for n in names if names.count(n) > 1})}")
    return names


def counts(records: DataFrame, names: Iterable[str]) -> DataFrame:
    """Records by source, 0 for a source without any."""
    spark = records.sparkSession
    known = spark.createDataFrame([(n,) for n in checked(names)], "source_id string")
    n = records.groupBy("source_id").agg(F.count("*").alias("n"))
    return known.join(n, "source_id", "left").select("source_id", F.coalesce("n", F.lit(0)).alias("n"))


#: The acts of the synthetic incident, in seconds from its start: who writes, how many lines, from when to
#: when, at which level, and what. ``{n}`` is a number, ``{k}`` one of a few keys that acts share.
ACTS = [
    ("gate", 600, 0, 600, "INFO", "GET /basket/{n} HTTP/1.1 200 in {n}ms trace_id={t}"),
    ("stock", 160, 0, 600, "info", "reserved {n} items"),
    ("ledger", 60, 0, 600, "LOG", "vacuum finished, {n} rows"),
    ("mailer", 80, 0, 600, "INFO", "letter {n} delivered trace_id={t}"),
    ("stock", 30, 300, 340, "error", "cache node lost: ConnectionError after {n}ms"),
    ("ledger", 45, 310, 380, "ERROR", "too many connections: {n} of 80"),
    ("gate", 110, 320, 400, "ERROR", "upstream stock answered 503, trace_id={k}"),
    ("gate", 200, 392, 399, "ERROR", "upstream stock answered 503, trace_id={k}"),
    ("mailer", 260, 330, 430, "WARN", "retrying letter {n}, trace_id={k}"),
    ("edge", 25, 335, 420, "error", "{n}#0: upstream timed out reading from gate"),
]
#: How each service of the incident writes: file suffix, format and the line around a message.
WRITERS = {
    "gate": (".log", "plain", "{at:%Y-%m-%d %H:%M:%S}.{ms:03d} {level} shop.gate {text}"),
    "stock": (".jsonl", "json", '{{"time": "{at:%Y-%m-%dT%H:%M:%S}.{ms:03d}Z", "severity": "{level}", "message": "{text}", "app": "stock", "trace_id": "{key}"}}'),
    "ledger": (".log", "plain", "{at:%Y-%m-%dT%H:%M:%S}.{ms:03d}Z [{level}] {text}"),
    "edge": (".log", "plain", "{at:%Y/%m/%d %H:%M:%S} [{level}] {text}"),
    "mailer": ("-json.log", "docker_json", '{{"log": "{at:%Y-%m-%d %H:%M:%S} {level} post.office {text}\\n", "stream": "stdout", "time": "{at:%Y-%m-%dT%H:%M:%S}.{ms:03d}000000Z"}}'),
}
#: Which service calls which in the synthetic incident.
DEPENDENCIES = [("edge", "gate"), ("gate", "stock"), ("stock", "ledger"), ("mailer", "stock")]


def synthetic_incident(folder: str, seed: int = 3, base: datetime = datetime(2025, 3, 2, 8, 0, tzinfo=UTC)) -> dict[str, tuple[str, str]]:
    """Write the lines of ACTS, a shop that loses its cache; {service: (path, format)}."""
    rng = random.Random(seed)
    keys = [f"k{i}" for i in range(9)]
    rows: dict[str, list] = {name: [] for name in WRITERS}
    for name, count, begin, end, level, text in ACTS:
        for _ in range(count):
            ms, key = int(1000 * rng.uniform(begin, end)), rng.choice(keys)
            filled = text.format(n=rng.randrange(10, 5000), t=f"r{rng.randrange(10**6)}", k=key)
            rows[name].append((ms, WRITERS[name][2].format(at=base + timedelta(milliseconds=ms), ms=ms % 1000, level=level, text=filled, key=key)))
    out = {}
    for name, (suffix, kind, _) in WRITERS.items():
        path = Path(folder, name + suffix)
        path.write_text("".join(line + "\n" for _, line in sorted(rows[name])), encoding="utf-8")
        out[name] = (str(path), kind)
    return out


def read_incident(spark: SparkSession, files: dict[str, tuple[str, str]], received_at: datetime) -> DataFrame:
    """Raw records of all files of a synthetic incident."""
    parts = []
    for name in checked(files):
        path, kind = files[name]
        parts.append(read_container(spark, path, name, received_at) if kind == "docker_json" else read_lines(spark, path, Path(path).name, kind, received_at))
    return reduce(DataFrame.unionByName, parts)
