"""An inverted-file index over vectors: cells around centroids, as tables, and searches that read few cells.

Centroids are fitted on a bounded sample; every row is indexed, at its nearest centroid, and cells with many rows
are split into parts of a bounded size. A search routes each question to the parts of its nearest cells, where one
matrix product finds the best; questions and rows meet by a shuffle, never at the driver. With ``exact`` a second
pass reads every cell that can hold a nearer row, by the triangle inequality, so nothing is missed.

Distances are cosine distances; zero and null vectors have none and are neither indexed nor asked for. Ties go to
the smaller key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of the sample, of a part, and the most cells; together they bound what the driver and a task hold.
SAMPLE, PART, MOST = 20_000, 50_000, 1024


def _units(column: pa.Array) -> np.ndarray:
    """Rows as unit vectors; a list column without nulls."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _real(df: DataFrame, vector: str) -> DataFrame:
    return df.filter(F.col(vector).isNotNull() & F.exists(vector, lambda x: x != 0))


def centroids(sample: np.ndarray, cells: int, rounds: int = 10, seed: int = 0) -> np.ndarray:
    """Unit centroids by spherical k-means; an empty cell takes a row of the sample."""
    r = np.random.default_rng(seed)
    at = sample[r.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        own = (sample @ at.T).argmax(axis=1)
        total = np.zeros_like(at)
        np.add.at(total, own, sample)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        at = np.where(norm > 1e-12, total / np.maximum(norm, 1e-12), sample[r.choice(len(sample), len(at))])
    return at


@dataclass
class Index:
    """rows (cell, part, key, vector) by cell and part, and cells (cell, parts, radius, centroid)."""

    path: str
    key: str
    kind: str

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"part int, key {self.kind}, vector array<double>, cell int").parquet(f"{self.path}/rows")

    def cells(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/cells")


def build(vectors: DataFrame, key: str, vector: str, path: str, cells: int | None = None, sample: int = SAMPLE, part: int = PART) -> Index:
    """Index ``vectors``; by default about as many cells as the root of the rows, at most MOST."""
    spark, real = vectors.sparkSession, _real(vectors.select(key, vector), vector)
    n = real.count()
    picked = real.orderBy(F.xxhash64(key), key).limit(sample).select(vector).toArrow().column(0).combine_chunks()  # ``sample`` rows
    cells = min(cells or int(np.sqrt(n)) + 1, MOST, max(n, 1))
    at = centroids(_units(picked), cells) if n else np.zeros((1, 1))
    shared: Broadcast = spark.sparkContext.broadcast(at)  # MOST vectors
    schema = real.select(F.lit(0).alias("cell"), F.lit(0.0).alias("far"), F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector")).schema

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            units = _units(batch.column(1))
            score = units @ shared.value.T
            cell = score.argmax(axis=1)
            far = np.linalg.norm(units - shared.value[cell], axis=1)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, units.size + 1, units.shape[1]), pa.int32()), pa.array(units.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(far), batch.column(0), flat], names=["cell", "far", "key", "vector"])

    placed = real.mapInArrow(assign, schema)
    placed.write.parquet(f"{path}/placed")
    placed = spark.read.parquet(f"{path}/placed")
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).withColumn("parts", F.ceil(F.col("n") / part).cast("int"))
    found = {r.cell: r for r in sizes.collect()}  # a row a cell
    table = [(c, found[c].parts, found[c].radius, at[c].tolist()) for c in sorted(found)]
    spark.createDataFrame(table, "cell int, parts int, radius double, centroid array<double>").coalesce(1).write.parquet(f"{path}/cells")
    rows = placed.join(F.broadcast(sizes.select("cell", "parts")), "cell")  # a row a cell
    rows = rows.select("cell", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"), "key", "vector")
    rows.repartition("cell", "part").write.partitionBy("cell").parquet(f"{path}/rows")
    return Index(path, key, real.schema[key].dataType.simpleString())


def _meet(asked: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(question, key, distance): each part's best for the questions that came to it."""
    schema = asked.join(rows.select("key"), F.lit(False)).select("question", "key", F.lit(0.0).alias("distance")).schema
    width = 512  # questions in one product

    def run(q: pa.Table, r: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if q.num_rows and r.num_rows:
            keys = r.column("key").to_pylist()
            order = sorted(range(len(keys)), key=lambda i: keys[i])
            keys, units = [keys[i] for i in order], _units(r.column("vector").combine_chunks())[order]
            place = {x: i for i, x in enumerate(keys)}
            names, without, asks = q.column("question").to_pylist(), q.column("exclude").to_pylist(), _units(q.column("vector").combine_chunks())
            for at in range(0, len(names), width):
                far = np.round(1 - asks[at : at + width] @ units.T, 12)
                for i, row in enumerate(far, at):
                    if without[i] in place:
                        row[place[without[i]]] = np.inf
                    best = np.argsort(row, kind="stable")[:k]  # in order of the key, which breaks ties
                    best = best[np.isfinite(row[best])]
                    for values, more in zip(out, ([names[i]] * len(best), [keys[j] for j in best], row[best].tolist())):
                        values.extend(more)
        return pa.table([pa.array(v, t) for v, t in zip(out, (q.schema.field("question").type, r.schema.field("key").type, pa.float64()))], names=["question", "key", "distance"])

    return asked.groupBy("cell", "part").cogroup(rows.groupBy("cell", "part")).applyInArrow(run, schema)


def _best(found: DataFrame, k: int) -> DataFrame:
    line = Window.partitionBy("question").orderBy("distance", "key")
    return found.withColumn("rank", F.row_number().over(line)).filter(F.col("rank") <= k)


def search(index: Index, questions: DataFrame, k: int = 10, probes: int = 8, exact: bool = False) -> DataFrame:
    """(question, key, distance, rank from 1) for ``questions(question, vector, exclude)``: the k nearest in the
    ``probes`` nearest cells; with ``exact`` the k nearest of all."""
    spark = questions.sparkSession
    questions = _real(questions, "vector").select("question", F.col("vector").cast("array<double>").alias("vector"), "exclude")
    table = sorted(index.cells(spark).collect())  # MOST rows
    if not table:
        return questions.join(index.rows(spark).select("key"), F.lit(False)).select("question", "key", F.lit(0.0).alias("distance"), F.lit(0).alias("rank"))
    cells = np.array([c.cell for c in table])
    shared = spark.sparkContext.broadcast((cells, np.array([c.centroid for c in table]), np.array([c.radius for c in table]), [c.parts for c in table]))
    rows = index.rows(spark)
    schema = questions.select("question", "vector", "exclude", F.lit(0).alias("cell"), F.lit(0).alias("part")).schema

    def routed(asked: DataFrame, second: bool) -> DataFrame:
        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, at, radius, parts = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                units = _units(batch.column(1))
                far = np.sqrt(np.maximum(2 - 2 * (units @ at.T), 0))
                near = np.argsort(far, axis=1, kind="stable")
                who, cell, part = [], [], []
                for i in range(len(units)):
                    own = near[i, :probes]
                    if second:  # cells that may hold a row nearer than the k-th so far: cosine distance is half the squared one
                        limit = batch.column(3)[i].as_py()
                        rest = near[i, probes:]
                        own = rest if limit is None else rest[far[i, rest] - radius[rest] <= np.sqrt(2 * max(limit, 0.0)) + 1e-9]
                    for c in own:
                        who += [i] * parts[c]
                        cell += [int(names[c])] * parts[c]
                        part += range(parts[c])
                head = batch.select([0, 1, 2]).take(pa.array(who, pa.int32()))
                yield pa.RecordBatch.from_arrays([*head.columns, pa.array(cell, pa.int32()), pa.array(part, pa.int32())], names=["question", "vector", "exclude", "cell", "part"])

        return asked.mapInArrow(route, schema)

    first = _meet(routed(questions, False), rows, k)
    if not exact:
        return _best(first, k)
    limit = _best(first, k).filter(F.col("rank") == k).select("question", F.col("distance").alias("limit"))
    again = questions.join(limit, "question", "left").select("question", "vector", "exclude", "limit")
    return _best(first.union(_meet(routed(again, True), rows, k)), k)


def recall(index: Index, questions: DataFrame, k: int = 10, probes: int = 8) -> float:
    """The share of the exact answers that a search finds."""
    exact = search(index, questions, k, probes, True).select("question", "key")
    found = search(index, questions, k, probes).select("question", "key", F.lit(1).alias("hit"))
    return float(exact.join(found, ["question", "key"], "left").agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0] or 0.0)


def tuned(index: Index, questions: DataFrame, k: int = 10, least: float = 0.9) -> int:
    """Probes, doubled until a search over ``questions`` has a recall of ``least``; all cells at the latest."""
    cells, probes = index.cells(questions.sparkSession).count(), 1
    while probes < cells and recall(index, questions, k, probes) < least:
        probes *= 2
    return min(probes, max(cells, 1))
