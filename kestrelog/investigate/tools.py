"""The tools of an investigation: named, checked, audited queries, and a scripted agent that uses them."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession

from kestrelog.functions.text import SEVERITIES
from kestrelog.operators import query
from kestrelog.sources import repo

REQUIRED = object()


@dataclass(frozen=True)
class Arg:
    kind: type
    default: object = REQUIRED
    low: float | None = None
    high: float | None = None
    least: int | None = None

    def check(self, name: str, value: object) -> object:
        if value is None:
            return None
        if self.kind is datetime:
            value = datetime.fromisoformat(value) if isinstance(value, str) else value
            return value.replace(tzinfo=UTC) if value.tzinfo is None else value
        if not isinstance(value, self.kind) or isinstance(value, bool) != (self.kind is bool):
            raise ValueError(f"{name}: not of type {self.kind.__name__}")
        if self.low is not None and not self.low <= value <= self.high:
            raise ValueError(f"{name}: not from {self.low} to {self.high}")
        if self.least is not None and len(value) < self.least:
            raise ValueError(f"{name}: shorter than {self.least}")
        return value


@dataclass(frozen=True)
class Tool:
    name: str
    args: dict[str, Arg]
    run: Callable[..., DataFrame]


@dataclass
class Registry:
    """Tools by name; every call is checked and leaves a row in ``audit``."""

    tools: dict[str, Tool] = field(default_factory=dict)
    audit: list[dict] = field(default_factory=list)
    seconds: float = 10.0
    rows: int = 10_000

    def add(self, tool: Tool) -> None:
        if tool.name in self.tools:
            raise ValueError(f"two tools named {tool.name}")
        self.tools[tool.name] = tool

    def only(self, names: list[str]) -> Registry:
        return Registry({n: self.tools[n] for n in names}, self.audit, self.seconds, self.rows)

    def _rows(self, frame: DataFrame) -> list[dict]:
        """The rows of a frame, within the time and number that a call may take; else its jobs are ended."""
        context, group = frame.sparkSession.sparkContext, uuid.uuid4().hex
        out: list = []

        def collect():
            try:
                context.setJobGroup(group, "tool", interruptOnCancel=True)
                out.append(frame.limit(self.rows + 1).collect())
            except Exception as e:
                out.append(e)

        thread = InheritableThread(target=collect, daemon=True)
        thread.start()
        thread.join(self.seconds)
        if not out:
            context.cancelJobGroup(group)
            raise TimeoutError(f"no answer within {self.seconds:g} s")
        if isinstance(out[0], Exception):
            raise out[0]
        if len(out[0]) > self.rows:
            raise ValueError(f"more than {self.rows} rows")
        return [r.asDict(recursive=True) for r in out[0]]

    def call(self, name: str, arguments: dict, agent: str = "user") -> list[dict]:
        began, outcome, detail, rows = time.time(), "ok", "", []
        try:
            tool = self.tools[name]
            if extra := set(arguments) - set(tool.args):
                raise ValueError(f"unknown arguments: {sorted(extra)}")
            values = {}
            for key, arg in tool.args.items():
                if key not in arguments and arg.default is REQUIRED:
                    raise ValueError(f"{key}: missing")
                values[key] = arg.check(key, arguments.get(key, arg.default))
            rows = self._rows(tool.run(**values))
            detail = json.dumps(rows, default=str)[:2000]
            return rows
        except Exception as e:
            outcome, detail = "timeout" if isinstance(e, TimeoutError) else "error", str(e)[:2000]
            raise
        finally:
            self.audit.append({"agent": agent, "tool": name, "arguments": json.dumps(arguments, default=str), "outcome": outcome, "detail": detail, "duration_ms": 1000 * (time.time() - began)})

    def audited(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.audit, "agent string, tool string, arguments string, outcome string, detail string, duration_ms double")


def registry(spark: SparkSession, events: DataFrame, clusters: DataFrame, deps: DataFrame, root: str | None = None) -> Registry:
    """The tools over one incident's tables, and over a source tree if ``root`` is given."""
    r, span = Registry(), {"start": Arg(datetime), "end": Arg(datetime)}
    limit = lambda d, high=100: Arg(int, d, 1, high)
    many = {"limit": limit(30)}

    def severity(x: str) -> int:
        return SEVERITIES[x.upper()]

    r.add(Tool("inspect_event_window", span | {"service": Arg(str, None), "min_severity": Arg(str, "DEBUG")} | many, lambda start, end, service, min_severity, limit: query.digest(query.window(events, start, end, service, severity(min_severity), limit))))
    r.add(Tool("search_events", {"query": Arg(str, least=2), "only_errors": Arg(bool, False)} | many, lambda query, only_errors, limit: _query_search(events, query, only_errors, limit)))
    r.add(Tool("find_similar_events", {"event_id": Arg(str), "limit": limit(20)}, lambda event_id, limit: query.digest(query.similar_to(events, event_id).orderBy("timestamp", "ord").limit(limit))))
    r.add(Tool("analyze_db_connections", span, lambda start, end: query.pool_pressure(events, start, end).orderBy("service")))
    r.add(Tool("calculate_error_rate", {"service": Arg(str)} | span | {"bucket_seconds": Arg(int, 10, 1, 300)}, lambda service, start, end, bucket_seconds: query.error_rate(events, bucket_seconds, start, end, service).orderBy("bucket")))
    r.add(Tool("inspect_dependency_graph", {"service": Arg(str, None)}, lambda service: query.dependencies(deps).filter("true" if service is None else query.F.col("name") == service)))
    r.add(Tool("get_anomaly_details", {"kind": Arg(str, None)}, lambda kind: query.anomalies(clusters, kind)))
    if root is not None:
        r.add(Tool("list_repo_files", {"pattern": Arg(str, "*"), "limit": limit(100, 500)}, lambda pattern, limit: repo.list_files(spark, root, pattern, limit)))
        r.add(Tool("read_source", {"path": Arg(str), "start": Arg(int, 1, 1, 10**9), "end": Arg(int, None, 1, 10**9)}, lambda path, start, end: repo.read_lines(spark, root, path, start, end)))
        r.add(Tool("search_source", {"query": Arg(str, least=2), "glob": Arg(str, "*"), "regex": Arg(bool, False)} | many, lambda query, glob, regex, limit: repo.search(spark, root, query, glob, regex, limit)))
        r.add(Tool("git_history", {"path": Arg(str, None), "limit": limit(20, 50)}, lambda path, limit: repo.history(spark, root, path, limit)))
        r.add(Tool("find_symbol", {"name": Arg(str, least=1)}, lambda name: repo.find_symbol(spark, root, name)))
    return r


def _query_search(events, text, only_errors, limit):
    return query.digest(query.search(events, text, only_errors, limit))


@dataclass
class ScriptedAgent:
    """Replays a list of steps: (tool, arguments) or, last, a finding; at most ``budget`` tool calls."""

    name: str
    steps: list
    budget: int = 8

    def investigate(self, tools: Registry) -> dict:
        used, seen = 0, []
        for step in self.steps:
            if isinstance(step, dict):
                return {"agent": self.name, "finding": step, "evidence": seen}
            if used == self.budget:
                break
            used += 1
            try:
                seen.append((step[0], len(tools.call(*step, agent=self.name))))
            except Exception as e:
                seen.append((step[0], str(e)[:200]))
        return {"agent": self.name, "finding": None, "evidence": seen}


def first_object(text: str) -> dict | None:
    """The JSON object from the first brace to the last, if it is one."""
    a, b = text.find("{"), text.rfind("}")
    try:
        found = json.loads(text[a : b + 1]) if 0 <= a < b else None
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def touched(diff: str) -> set[str]:
    """Every path that a diff names in its headers, whatever its prefix; not /dev/null."""
    out = set()
    for line in diff.splitlines():
        head, _, rest = line.partition(" ")
        if line.startswith("diff --git "):
            names = line[11:].split(" ")
        elif head in ("---", "+++") or line.startswith(("---\t", "+++\t")):
            names = [(rest or line[4:]).lstrip().split("\t")[0].split(" ")[0]]
        elif head in ("rename", "copy") and rest.startswith(("from ", "to ")):
            names = [rest.partition(" ")[2]]
        else:
            continue
        out |= {n[2:] if n[:2] in ("a/", "b/") and head not in ("rename", "copy") else n for n in names if n}
    return out - {"/dev/null"}


def patch_problems(diff: str, declared: set[str]) -> list[str]:
    """What speaks against a patch: no files, files not declared, paths outside, declared ones too."""
    paths = touched(diff)
    out = ["no files"] if not paths else [f"not declared: {p}" for p in sorted(paths - declared)]
    for p in sorted(paths | declared):
        try:
            repo.inside(p)
        except ValueError:
            out.append(f"outside: {p}")
    return out
