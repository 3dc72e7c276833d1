"""Operator 8: exact dedup by Patricia-trie owners.

Rows of one batch with equal texts are folded first, then go to partitions by length and content hash.
The owner of a partition inserts the full byte strings into a compressed radix trie whose terminal
nodes hold the group's kept row and size; when the trie outgrows its budget, whole subtrees go to spill
files of the task in Spark's own local folders and are finished later, one at a time. Equality is decided
by the bytes alone. A hot text reaches its owner once per batch and not once per row, and the owners'
verdicts come back to the rows by a join that Spark may split.

Null counts as empty; empty texts are one group. Repeated rows count as often as they stand, and one of
them at most is kept; extra columns are ignored. A null doc_id is kept only where its group has no other
id. Rows are numbered as Spark reads them, so the input should be a table, or read from one.
"""

from __future__ import annotations

import os
import pickle
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelog.llm.common import arrow_type, numbered

#: Bytes that an owner's trie holds before it spills, and what a node takes besides its label.
BUDGET, NODE = 192 << 20, 400


class Node:
    __slots__ = ("children", "end", "label", "spill")

    def __init__(self, label: bytes):
        self.label, self.children, self.end, self.spill = label, {}, None, None


def _common(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix of ``a`` and ``b[start:]``."""
    low, high = 0, min(len(a), len(b) - start)
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[start + low : start + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class PatriciaTrie:
    """Byte strings with a row and a count each; ``best`` picks the row that a group keeps."""

    def __init__(self, best: Callable = min, budget: int = BUDGET):
        self.root, self.best, self.budget, self.held = Node(b""), best, budget, 0

    def insert(self, key: bytes, row, count: int = 1) -> None:
        node, at = self.root, 0
        while True:
            if at == len(key):
                break
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key[at:])
                self.held += len(key) - at + NODE
                node, at = child, len(key)
                break
            same = len(child.label) if key.startswith(child.label, at) else _common(child.label, key, at)
            if same < len(child.label):  # split the edge
                middle = Node(child.label[:same])
                child.label = child.label[same:]
                middle.children[child.label[0]] = child
                node.children[key[at]] = middle
                self.held += NODE
                child = middle
            node, at = child, at + same
            if node.spill is not None:
                pickle.dump((key, row, count), node.spill)
                return
        node.end = (row, count) if node.end is None else (self.best(node.end[0], row), node.end[1] + count)
        if self.held > self.budget:
            self._spill()

    def _spill(self) -> None:
        """Write the largest subtree below the first branching to a file of its own. Of a spilled subtree
        one byte and the file stay, so what is held can always be brought down to the strings' common
        beginning and 256 nodes."""
        node, prefix = self.root, b""
        while len(node.children) == 1 and node.spill is None:
            node = next(iter(node.children.values()))
            prefix += node.label
        sizes = {}
        for first, child in node.children.items():
            if child.spill is None:
                size, stack = -1 - NODE, [child]
                while stack:
                    x = stack.pop()
                    size += len(x.label) + NODE
                    stack.extend(x.children.values())
                sizes[first] = size
        if not any(sizes.values()):
            return
        child = node.children[max(sizes, key=sizes.get)]
        file = tempfile.TemporaryFile(dir=_folder())  # the task's own, like Spark's spill files
        inner = [(child, prefix + child.label)]
        while inner:
            x, path = inner.pop()
            if x.spill is not None:
                x.spill.seek(0)
                while record := _read(x.spill):
                    pickle.dump(record, file)
                x.spill.close()
            if x.end is not None:
                pickle.dump((path, *x.end), file)
            inner.extend((y, path + y.label) for y in x.children.values())
        self.held -= max(sizes.values())
        child.label, child.children, child.end, child.spill = child.label[:1], {}, None, file

    def items(self) -> Iterator[tuple]:
        """Every distinct string once, with the kept row and the group's size."""
        spilled = []
        stack = [(self.root, b"")]
        while stack:
            node, prefix = stack.pop()
            if node.spill is not None:
                spilled.append(node.spill)
                continue
            if node.end is not None:
                yield prefix, *node.end
            stack.extend((child, prefix + child.label) for child in node.children.values())
        self.root = Node(b"")
        for file in spilled:
            file.seek(0)
            part = PatriciaTrie(self.best, self.budget)
            while record := _read(file):
                part.insert(*record)
            file.close()
            yield from part.items()


def _folder() -> str | None:
    """A local folder that Spark gave this executor and clears itself; outside of tasks the system's."""
    own = (os.environ.get("SPARK_LOCAL_DIRS") or os.environ.get("LOCAL_DIRS") or "").split(",")[0]
    return own or (SparkFiles.getRootDirectory() if TaskContext.get() else None)


def _read(file):
    try:
        return pickle.load(file)
    except EOFError:
        return None


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("row", F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return rows.select("row", "doc_id", "text", F.octet_length("text").cast("long").alias("n"), F.xxhash64("text").alias("h"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))


def owners(docs: DataFrame, keep: str = "max", budget: int = BUDGET) -> DataFrame:
    """One row per distinct text of numbered rows: sha, keep_id, keep_row, group_size. Of the rows with the
    kept id the first stays. ``keep``: min or max."""
    choose = {"min": min, "max": max}[keep]

    def best(a, b):
        """Of (doc_id, row) pairs the one that a group keeps."""
        if a[0] == b[0]:
            return min(a, b, key=lambda x: x[1])
        return b if a[0] is None else a if b[0] is None else choose(a, b)

    folded_ddl = "n long, h long, sha string, text binary, doc_id long, row long, size long"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[bytes, list] = {}
            rows, ids, ns, hs, shas = (batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5))
            for i, value in enumerate(batch.column(2).cast(pa.binary())):
                key, own = value.as_py(), (ids[i], rows[i])
                if (old := seen.get(key)) is None:
                    seen[key] = [ns[i], hs[i], shas[i], own, 1]
                else:
                    old[3], old[4] = best(old[3], own), old[4] + 1
            v = list(seen.values())
            columns = [[x[0] for x in v], [x[1] for x in v], [x[2] for x in v], list(seen), [x[3][0] for x in v], [x[3][1] for x in v], [x[4] for x in v]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow_type(folded_ddl).types)], schema=arrow_type(folded_ddl))

    owned_ddl = "sha string, keep_id long, keep_row long, group_size long"

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        def table(out):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, arrow_type(owned_ddl).types)], schema=arrow_type(owned_ddl))

        trie = PatriciaTrie(best, budget)
        for batch in batches:
            texts, ids, rows, counts = (batch.column(i) for i in range(4))
            for key, doc_id, row, count in zip(texts, ids.to_pylist(), rows.to_pylist(), counts.to_pylist()):
                trie.insert(key.as_py(), (doc_id, row), count)
        out: list[tuple] = []
        for key, (doc_id, row), count in trie.items():
            out.append((hashlib.sha256(key).hexdigest(), doc_id, row, count))
            if len(out) == 20_000:
                yield table(out)
                out = []
        yield table(out)

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _keyed(docs).mapInArrow(fold, folded_ddl).repartition(parts, "n", "h").select("text", "doc_id", "row", "size")
    return dealt.mapInArrow(own, owned_ddl)


def exact_groups(docs: DataFrame, keep: str = "max", budget: int = BUDGET) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. ``keep``: min or max."""
    rows = numbered(docs)
    found = _keyed(rows).select("row", "doc_id", "sha").join(owners(rows, keep, budget), "sha")
    return found.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256"))


def unique(docs: DataFrame, keep: str = "max", budget: int = BUDGET) -> DataFrame:
    """The kept row of each group, with its columns. Rows meet by their number, which no two share."""
    rows = numbered(docs)
    kept = owners(rows, keep, budget).select(F.col("keep_row").alias("row"))
    return rows.join(kept, "row", "left_semi").select("document.*")
