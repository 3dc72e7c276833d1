"""Incident memory: hashed word vectors, cosine top-k, recall."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def embed(texts: DataFrame, key: str, text: str, dim: int = 1024) -> DataFrame:
    """(key, bucket, weight): sparse unit vectors of the words of a text. A word's hash gives bucket and
    sign; a text without words has no rows, the zero vector."""
    words = texts.select(key, F.explode(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]{2,})"), F.lit(1))).alias("w"))
    h = F.sha2("w", 256)
    bucket = F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % dim
    sign = F.when(F.conv(F.substring(h, 9, 2), 16, 10).cast("long") % 2 == 0, 1.0).otherwise(-1.0)
    parts = words.groupBy(key, bucket.alias("bucket")).agg(F.sum(sign).alias("value")).filter("value <> 0")
    norm = parts.groupBy(key).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    return parts.join(norm, key).select(key, "bucket", (F.col("value") / F.col("norm")).alias("weight"))


def dense(sparse: DataFrame, key: str, dim: int = 1024) -> DataFrame:
    """(key, embedding array<float>)."""
    m = sparse.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("m"))
    return m.select(key, F.transform(F.sequence(F.lit(0).cast("long"), F.lit(dim - 1).cast("long")), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0)).cast("float")).alias("embedding"))


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.try_divide(dot, norm(a) * norm(b))


def nearest(vectors: DataFrame, query: list[float], key: str, vector: str, k: int = 3, exclude: Column | None = None) -> DataFrame:
    """The k nearest by cosine distance, exactly: a scan and a top-k per task. ``exclude`` is a condition
    on rows to leave out; where it is null the row stays."""
    rows = vectors if exclude is None else vectors.filter(~F.coalesce(exclude, F.lit(False)))
    q = F.array(*[F.lit(float(x)) for x in query])
    return rows.select(key, (1 - cosine(F.col(vector), q)).alias("distance")).orderBy("distance", key).limit(k)


def similar(memory: DataFrame, questions: DataFrame, key: str = "incident_id", k: int = 3, least: float = 0.3, dim: int = 1024, block: int = 1000) -> DataFrame:
    """(question, key, similarity): per question (question, text, exclude) the k most similar memories by
    their text, then only those of at least ``least``.

    Questions are broadcast as dense vectors, ``block`` at a time; each batch of memories meets all of them
    in one matrix product and passes on its k best a question, so what is shuffled doesn't grow with
    matches. Memories that share no word with a question have similarity 0 and are never an answer.
    """
    spark = memory.sparkSession
    sparse = embed(memory, key, "text", dim).groupBy(key).agg(F.collect_list("bucket").alias("b"), F.collect_list("weight").alias("w"))
    asked = embed(questions, "question", "text", dim).groupBy("question").agg(F.collect_list("bucket").alias("b"), F.collect_list("weight").alias("w"))
    schema = T.StructType([T.StructField("question", questions.schema["question"].dataType), T.StructField(key, memory.schema[key].dataType), T.StructField("similarity", T.DoubleType())])
    best, held = None, []

    def part(held: list) -> DataFrame:
        matrix = np.zeros((len(held), dim))
        for i, row in enumerate(held):
            matrix[i, row.b] = row.w
        shared = spark.sparkContext.broadcast(([r.question for r in held], [r.exclude for r in held], matrix))  # block * dim numbers

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, without, matrix = shared.value
            for batch in batches:
                ids, buckets, weights = (c.to_pylist() for c in batch.columns)
                vectors = np.zeros((len(ids), dim))
                for i, (b, w) in enumerate(zip(buckets, weights)):
                    vectors[i, b] = w
                order, place = sorted(range(len(ids)), key=lambda i: ids[i]), {x: i for i, x in enumerate(ids)}
                scores = np.round(matrix @ vectors[order].T, 9)  # in order of the key, which breaks ties
                out = ([], [], [])
                for q, row in enumerate(scores):
                    if without[q] is not None and without[q] in place:
                        row[order.index(place[without[q]])] = 0.0
                    top = np.argsort(-row, kind="stable")[:k]
                    top = top[row[top] > 0]
                    for values, more in zip(out, ([names[q]] * len(top), [ids[order[i]] for i in top], row[top].tolist())):
                        values.extend(more)
                yield pa.RecordBatch.from_arrays([pa.array(v, to_arrow_type(f.dataType)) for v, f in zip(out, schema.fields)], names=schema.fieldNames())

        return sparse.mapInArrow(run, schema)

    for row in asked.join(questions.select("question", "exclude"), "question").toLocalIterator():
        held.append(row)
        if len(held) == block:
            best, held = part(held) if best is None else best.union(part(held)), []
    if held or best is None:
        best = part(held) if best is None else best.union(part(held))
    top = best.withColumn("r", F.row_number().over(Window.partitionBy("question").orderBy(F.desc("similarity"), key))).filter(F.col("r") <= k)
    return top.filter(F.col("similarity") >= least).select("question", key, F.round("similarity", 4).alias("similarity"))


Embedder = Callable[[DataFrame, str, str], DataFrame]


def remote(call: Callable[[list[str]], list[list[float]]], size: int = 64) -> Embedder:
    """An embedder by a function from texts to vectors, as a service's client is: called with ``size``
    texts at a time from the executors; its errors end the task, which Spark tries again."""

    def embedder(texts: DataFrame, key: str, text: str) -> DataFrame:
        schema = T.StructType([T.StructField(key, texts.schema[key].dataType), T.StructField("embedding", T.ArrayType(T.FloatType()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, size):
                    piece = batch.slice(at, size)
                    found = call([t or "" for t in piece.column(1).to_pylist()])
                    yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(found, pa.list_(pa.float32()))], names=[key, "embedding"])

        return texts.select(key, text).mapInArrow(run, schema)

    return embedder


def build_embedder(provider: str = "hashing", dim: int = 1024, call: Callable | None = None) -> Embedder:
    """The embedder of a setting: ``hashing``, or ``remote`` by ``call``. (key, embedding array<float>)."""
    if provider == "hashing":
        return lambda texts, key, text: dense(embed(texts, key, text, dim), key, dim)
    if provider == "remote" and call is not None:
        return remote(call)
    raise ValueError(f"no embedder {provider!r}")


def remember(assessments: DataFrame) -> DataFrame:
    """Memory rows of finished investigations (incident_id, trigger, root_cause, affected_services, actions)."""
    text = F.format_string("%s -> %s. Affected services: %s.", "trigger", "root_cause", F.concat_ws(", ", "affected_services"))
    return assessments.select("incident_id", text.alias("text"), "root_cause", "affected_services", F.when(F.size("actions") > 0, F.concat_ws("; ", "actions")).alias("remediation"))


def as_evidence() -> Column:
    """One line about a similar incident."""
    return F.format_string("similar incident (%.2f): %s; remedy: %s", "similarity", "root_cause", F.coalesce("remediation", F.lit("none recorded")))
