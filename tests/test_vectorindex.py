"""The inverted-file index: exact search against a scan, measured recall, hot cells, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrelog.operators import memory, vectorindex

SF = "/root/testdata/sf0.01"


def ask(rows, condition):
    return rows.filter(condition).select(F.col("vec_id").alias("question"), F.col("embedding").alias("vector"), F.col("vec_id").alias("exclude"))


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")


@pytest.fixture(scope="module")
def index(vectors, tmp_path_factory):
    return vectorindex.build(vectors, "vec_id", "embedding", str(tmp_path_factory.mktemp("index") / "i"), part=60)


def brute(rows, who, k):
    ids = np.array([r.vec_id for r in rows])
    m = np.array([r.embedding for r in rows], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    out = {}
    for q in who:
        far = np.round(1 - m @ m[ids == q][0], 12)
        out[q] = [int(ids[i]) for i in sorted(range(len(ids)), key=lambda i: (far[i], ids[i])) if ids[i] != q][:k]
    return out


def test_exact_search_equals_a_scan_and_recall_is_high(spark, vectors, index):
    rows, questions = vectors.collect(), ask(vectors, "vec_id % 50 = 0")
    got = {}
    for r in vectorindex.search(index, questions, 10, exact=True).orderBy("question", "rank").collect():
        got.setdefault(r.question, []).append(r.key)
    assert got == brute(rows, got, 10) and len(got) == questions.count()
    one = rows[0]
    scan = [r.vec_id for r in memory.nearest(vectors, list(one.embedding), "vec_id", "embedding", 10, F.col("vec_id") == one.vec_id).collect()]
    assert got[one.vec_id] == scan
    cells = index.cells(spark).count()
    assert cells > 8 and index.rows(spark).count() == len(rows)


def test_recall_is_measured_and_tuned(spark, tmp_path):
    """Vectors around forty directions: few cells are enough for nine tenths of the answers."""
    r = np.random.default_rng(3)
    heads = r.normal(size=(40, 16))
    data = [(i, (heads[i % 40] + 0.3 * r.normal(size=16)).tolist()) for i in range(1200)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    index, questions = vectorindex.build(df, "vec_id", "embedding", str(tmp_path / "i")), ask(df, "vec_id % 50 = 0")
    probes = vectorindex.tuned(index, questions, 10)
    exact = brute(df.collect(), [q.question for q in questions.collect()], 10)
    found = vectorindex.search(index, questions, 10, probes).collect()
    share = sum(x.key in exact[x.question] for x in found) / sum(map(len, exact.values()))
    assert share >= 0.9 and probes <= index.cells(spark).count() // 2


def test_a_hot_cell_is_split_and_ties_go_to_the_smaller_key(spark, tmp_path):
    """Most rows are one vector; odd rows are left out."""
    data = [(i, [1.0, 0.0]) for i in range(300)] + [(1000 + i, [float(i), 1.0]) for i in range(20)] + [(5000, None), (5001, [0.0, 0.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    index = vectorindex.build(df, "vec_id", "embedding", str(tmp_path / "i"), cells=4, part=50)
    parts = index.rows(spark).groupBy("cell", "part").count().collect()
    assert max(r["count"] for r in parts) < 100 and index.rows(spark).count() == 320
    questions = ask(df, "vec_id in (7, 1000, 5000, 5001)")
    for probes, exact in ((1, True), (4, False)):
        got = {}
        for r in vectorindex.search(index, questions, 3, probes, exact).orderBy("question", "rank").collect():
            got.setdefault(r.question, []).append(r.key)
        assert got == {7: [0, 1, 2], 1000: [1001, 1002, 1003]}
    empty = vectorindex.build(df.limit(0), "vec_id", "embedding", str(tmp_path / "e"))
    assert vectorindex.search(empty, questions, 3).count() == 0
