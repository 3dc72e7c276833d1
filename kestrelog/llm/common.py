"""Shared helpers: tables, scratch tables in the shared checkpoint folder, caches, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Code points of the Unicode White_Space property, for use in a character class (fixed values).
WHITE_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def modest_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Fewer rows an Arrow batch than Spark's default, unless the session sets its own number: whole
    texts are long, and batches stand in the executor's memory several times."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) == 10_000:
        spark.conf.set(key, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    modest_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the cluster names in spark.checkpoint.dir.

    Only where that setting is empty (tests in local mode) a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="kestrelog-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/kestrelog/{uuid.uuid4().hex}-{name}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a shared table and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`materialize`."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def numbered(docs: DataFrame) -> DataFrame:
    """row (a number that no two rows share), doc_id, text and the whole row as ``document``.

    Rows of files are numbered by file, in order of the paths, and by place in it: the same whenever they
    are read, with whatever splits and executors. What isn't read from files with row numbers (tests) is
    numbered as Spark meets it.
    """
    spark, what = docs.sparkSession, ["doc_id", "text", F.struct("*").alias("document")]
    try:
        rows = docs.select(F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_index"), *what)
    except AnalysisException:
        return docs.select(F.monotonically_increasing_id().alias("row"), *what)
    paths = sorted(r[0] for r in rows.select("_path").distinct().collect())  # one for each file
    # a local relation: Spark knows its size, and broadcasts it below its threshold only
    files = spark.createDataFrame(pa.table({"_path": pa.array(paths, pa.string()), "_base": pa.array([i << 40 for i in range(len(paths))], pa.int64())}))
    return rows.join(files, "_path").select((F.col("_base") + F.col("_index")).alias("row"), "doc_id", "text", "document")


class Memo(dict):
    """Computed values by key, at most ``limit`` of them and none for keys longer than ``longest``, so bytes
    are bounded as well. A full half becomes the old one, whose values come back when they are asked for."""

    def __init__(self, compute, limit: int, longest: int = 64):
        super().__init__()
        self._compute, self._half, self._longest, self._old = compute, max(limit // 2, 1), longest, {}

    def __missing__(self, key):
        value = self._old.get(key)
        if value is None:
            value = self._compute(key)
        if len(key) <= self._longest:
            if len(self) >= self._half:
                self._old = dict(self)
                self.clear()
            self[key] = value
        return value


_kept: dict[tuple, object] = {}


def kept(kind: str, key, make):
    """``make()``, once a worker process for each ``kind`` and ``key``. A process holds only the last
    one: the caches of several operators side by side would not fit an executor."""
    if (kind, key) not in _kept:
        if _kept:
            _kept.clear()
            gc.collect()
            give_back()
        _kept[kind, key] = make()
    return _kept[kind, key]


def give_back() -> None:
    """Return a worker process's free memory to the system: it stays alive for later tasks of other stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that have run: they go when their plan is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def arrow_type(ddl: str) -> pa.Schema:
    """Arrow schema of a flat DDL string of long, int, double, string, binary and boolean columns."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(part.split()[0], kinds[part.split()[1]]) for part in ddl.split(", ")])


def map_rows(docs: DataFrame, run, ddl: str, carry: bool) -> DataFrame:
    """``run`` over batches of doc_id and text and, with ``carry``, the whole row as a last struct column."""
    doc_id, schema = F.col("doc_id").cast("long").alias("doc_id"), T.StructType.fromDDL(ddl)
    if not carry:
        return docs.select(doc_id, "text").mapInArrow(run, schema)

    def with_text(batches):  # the text is taken from the row: it isn't sent twice
        for batch in batches:
            row = batch.column(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), row.field(row.type.get_field_index("text")), row], names=["doc_id", "text", "row"])

    return docs.select(doc_id, F.struct("*").alias("row")).mapInArrow(lambda batches: run(with_text(batches)), schema.add("row", docs.schema))


def sieve(ids: DataFrame) -> Callable[[Column], Column]:
    """A test for long columns: false where no row of ``ids`` (one long column) has the value, true where one has.

    A Bloom filter of 16 bits an id and 4 MB at most lets few others through (more, where ids are very many),
    so what has to be exact joins what is left. Long texts are thus picked by id, or left out, where they are
    read: only those that pass, not all of them, are shuffled for the join.
    """
    spark = ids.sparkSession
    bits = 1 << min(25, max(16, (16 * ids.count()).bit_length()))

    def places(values: pa.Array) -> np.ndarray:
        x = values.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
            x = (x ^ (x >> np.uint64(31))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
        return ((x + np.arange(4, dtype=np.uint64)[:, None] * (x >> np.uint64(32) | np.uint64(1))) & np.uint64(bits - 1)).astype(np.int64)

    def marks(batches):
        for batch in batches:
            at = places(batch.column(0)).ravel()
            words, which = np.unique(at >> 6, return_inverse=True)
            held = np.zeros(len(words), np.uint64)
            np.bitwise_or.at(held, which, np.uint64(1) << (at & 63).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(held.view(np.int64))], names=["word", "held"])

    found = ids.mapInArrow(marks, "word long, held long").groupBy("word").agg(F.bit_or("held").alias("held")).toArrow()
    words = np.zeros(bits >> 6, np.uint64)
    words[found["word"].to_numpy()] = found["held"].to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast(words)

    @F.arrow_udf("boolean")
    def among(values: pa.Array) -> pa.Array:
        at = places(values)
        seen = (shared.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).all(axis=0)
        return pa.array(seen & values.is_valid().to_numpy(zero_copy_only=False))

    return among


def _contract(batches):
    """Union-find over the edges of one partition: (node, smallest node it reaches there)."""
    parent: dict[int, int] = {}

    def find(x):
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    pairs = [(x, find(x)) for x in parent]
    pairs = [(x, r) for x, r in pairs if x != r]
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([r for _, r in pairs], pa.int64())], names=["u", "v"])


def components(edges: DataFrame, name: str, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a long, b long)``: one row (node, component) per linked node
    that isn't its component's smallest node; component is the smallest node.

    Partitions are contracted first, then large-star and small-star steps alternate until the edges
    stay as they are. Links and labels never leave the executors; each round is a shared table, which
    goes once the next one stands.
    Self loops, repeated edges and an empty input are fine.
    """
    e = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").mapInArrow(_contract, "u long, v long")
    e = materialize(e.distinct(), name)

    def mark(df):
        return tuple(df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())

    before = mark(e)
    for _ in range(rounds):
        if before[0] == 0:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low)
        step = materialize(small.filter("u > v").distinct(), name)
        after, old, e = mark(step), e, step
        remove(e.sparkSession, old)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components of {name}: no fixed point after {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
