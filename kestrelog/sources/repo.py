"""Files of a source repository as tables: listing, numbered lines, search, symbols."""

from __future__ import annotations

import re
import subprocess
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that are no sources (fixed values).
SKIPPED = (".git", ".venv", "node_modules", "__pycache__", ".mypy_cache", ".ruff_cache")
MAX_BYTES, MAX_LINES = 1_000_000, 400


def inside(path: str) -> str:
    """A relative path that stays in its root; anything else is an error."""
    p = PurePosixPath(path.replace("\\", "/"))
    if not path or p.is_absolute() or ".." in p.parts or re.match(r"^[A-Za-z]:", path):
        raise ValueError(f"not a path in the repository: {path!r}")
    return str(p)


def glob_pattern(glob: str) -> str:
    """A pattern for relative paths: ``*`` and ``?`` stay in a folder, ``**`` is any number of folders, ``[...]`` a
    set of characters. A glob without a slash is for names in any folder."""
    parts, out = glob.replace("\\", "/").split("/"), []
    if len(parts) == 1 and glob != "**":
        parts = ["**", *parts]
    for i, part in enumerate(parts):
        if part == "**":
            out.append("(?:[^/]+/)*" if i < len(parts) - 1 else ".*")
            continue
        at, text = 0, ""
        while at < len(part):
            close = part.find("]", at + 2)
            if part[at] == "[" and close > 0:
                inner = part[at + 1 : close]
                text += "[" + ("^" if inner[0] == "!" else "") + re.sub(r"([\\\[&^])", r"\\\1", inner[inner[0] == "!" :]) + "]"
                at = close
            else:
                text += {"*": "[^/]*", "?": "[^/]"}.get(part[at], re.escape(part[at]))
            at += 1
        out.append(text + ("/" if i < len(parts) - 1 else ""))
    return "^" + "".join(out) + "$"


def files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, length, content) of the files whose relative paths match, paths relative to ``root``. The last part
    of the glob already keeps Spark from opening other files."""
    name = glob.replace("\\", "/").rpartition("/")[2]
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    df = (reader.option("pathGlobFilter", name) if re.fullmatch(r"[\w.*?-]+", name) and name != "**" else reader).load(root)
    relative = F.regexp_replace("path", "^(file:)?/*" + re.escape(str(root).replace("file:", "").strip("/")) + "/", "")
    return df.select(relative.alias("path"), "length", "content").filter(F.col("path").rlike(glob_pattern(glob))).filter(~F.col("path").rlike("(^|/)(" + "|".join(map(re.escape, SKIPPED)) + ")/"))


def list_files(spark: SparkSession, root: str, glob: str = "*", limit: int = 200) -> DataFrame:
    return files(spark, root, glob).select("path").orderBy("path").limit(limit)


def lines(found: DataFrame) -> DataFrame:
    """(path, line, text) with lines from 1; larger files are left out."""
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return found.filter(F.col("length") <= MAX_BYTES).select("path", F.posexplode(F.split(text, "\r?\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)


def read_lines(spark: SparkSession, root: str, path: str, start: int = 1, end: int | None = None) -> DataFrame:
    """A window of a file, at most MAX_LINES lines, each with its number."""
    path = inside(path)
    last = min(end if end is not None else start + MAX_LINES - 1, start + MAX_LINES - 1)
    found = files(spark, root, PurePosixPath(path).name).filter(F.col("path") == path)
    for row in found.select("length").collect():
        if row.length > MAX_BYTES:
            raise ValueError(f"{path}: larger than {MAX_BYTES} bytes")
    one = lines(found).filter(F.col("line").between(start, last))
    return one.select("line", F.format_string("%5d | %s", "line", "text").alias("text")).orderBy("line")


def search(spark: SparkSession, root: str, query: str, glob: str = "*", regex: bool = False, limit: int = 50) -> DataFrame:
    """Lines that hold a literal or a pattern, in any case, by path and line."""
    if regex:
        try:
            spark._jvm.java.util.regex.Pattern.compile(query)
        except Exception as error:
            raise ValueError(f"not a pattern: {query!r}") from error
    pattern = "(?iu)" + (query if regex else r"\Q" + query.replace(r"\E", r"\E\\E\Q") + r"\E")
    found = lines(files(spark, root, glob)).filter(F.col("text").rlike(pattern))
    return found.select("path", "line", F.substring(F.trim("text"), 1, 200).alias("text")).orderBy("path", "line").limit(limit)


def find_symbol(spark: SparkSession, root: str, name: str, limit: int = 20) -> DataFrame:
    """Where a function or class of this name is defined."""
    if not name.isidentifier():
        raise ValueError(f"not an identifier: {name!r}")
    return search(spark, root, rf"^\s*(?:async\s+def|def|class)\s+{name}\b", "*.py", True, limit)


def history(spark: SparkSession, root: str, path: str | None = None, limit: int = 20) -> DataFrame:
    """(commit, subject) of the latest commits that touch a path, newest first; a call of git at the driver."""
    command = ["git", "-C", str(root), "log", "--oneline", f"-{int(limit)}", "--", inside(path) if path else "."]
    done = subprocess.run(command, capture_output=True, text=True, timeout=10)
    if done.returncode:
        raise ValueError(f"no history: {done.stderr.strip()[:200]}")
    return spark.createDataFrame([tuple(line.partition(" ")[::2]) for line in done.stdout.splitlines()], "commit string, subject string")
