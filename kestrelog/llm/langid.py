"""Operator 6: language identification by rank-order profiles.

A profile is the list of the most frequent character n-grams (one to three characters, word ends
marked) of a language, by falling count. A document's own list is compared with each by out-of-place
distance: the sum of how far every n-gram of the document stands from its place in the profile, and
the full length of the profile for one that isn't there. The nearest profile names the language.

Profiles are counted over all training rows. Null texts and texts without a letter are ``und`` with
score 0; rows without a language or text teach nothing; with no profile at all every row is ``und``.
Ties go to the language that sorts first. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrelog.llm.common import arrow_type, materialize

#: Code points that are letters get themselves, all else is a word end (0).
LETTER = np.array([i if chr(i).isalpha() else 0 for i in range(0x110000)], np.int64)


def _points(text: str) -> np.ndarray:
    """Lower-case letters as code points, runs of anything else as one 0, with 0 at both ends."""
    a = np.frombuffer(("\0" + text.lower() + "\0").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    a = LETTER[a]
    keep = np.ones(len(a), bool)
    keep[1:] = (a[1:] != 0) | (a[:-1] != 0)
    return a[keep]


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram codes ascending, counts): three code points of 21 bits each; shorter n-grams end in the
    code 0x1FFFFF, and the lone word end isn't one."""
    a = _points(text)
    if len(a) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    none = 0x1FFFFF
    a = np.append(a, 0)
    tri, count = np.unique((a[:-2] << 42) | (a[1:-1] << 21) | a[2:], return_counts=True)
    # every letter begins one trigram, so shorter n-grams are sums over them
    inside = (tri >> 21 & none) != 0  # no trigram runs across words
    codes, counts = [tri[inside]], [count[inside]]
    two = tri >> 21
    first = np.flatnonzero(np.r_[True, two[1:] != two[:-1]])
    codes.append((two[first] << 21) | none)
    counts.append(np.add.reduceat(count, first))
    one = two >> 21
    first = np.flatnonzero(np.r_[True, one[1:] != one[:-1]])
    codes.append((one[first] << 42) | (none << 21) | none)
    counts.append(np.add.reduceat(count, first))
    codes, counts = np.concatenate(codes), np.concatenate(counts)
    real = codes >> 42 != 0
    real |= (codes & none) != none  # begins with a word end: only whole trigrams count
    codes, counts = codes[real], counts[real]
    order = np.argsort(codes)
    return codes[order], counts[order]


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent codes; equal counts in order of the code."""
    return codes[np.argsort(-counts, kind="stable")[:size]]


def profiles(docs: DataFrame, training: Column, size: int = 300) -> dict[str, list[int]]:
    """lang -> its ``size`` most frequent n-grams over all training rows. Counts are summed per batch,
    then by Spark; the driver gets the finished lists only."""
    ddl = "lang string, code long, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[str, list] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.setdefault(lang, []).append(ngrams(text.as_py()))
            for lang, found in held.items():
                codes, where = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
                total = np.bincount(where, weights=np.concatenate([n for _, n in found]), minlength=len(codes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(total)], schema=arrow_type(ddl))

    source = docs.filter(training & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counts = materialize(source.mapInArrow(run, ddl).groupBy("lang", "code").agg(F.sum("n").alias("n")), "ngrams")
    top = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))).filter(F.col("r") <= size)
    out: dict[str, list[tuple[int, int]]] = {}
    for row in top.select("lang", "code", "r").collect():
        out.setdefault(row.lang, []).append((row.r, row.code))
    return {lang: [code for _, code in sorted(rows)] for lang, rows in sorted(out.items())}


def identify(docs: DataFrame, learned: dict[str, list[int]], size: int = 300) -> DataFrame:
    """doc_id, lang_pred, score: the share of the runner-up's distance in the two smallest, from 0.5 (a
    tie) to 1; 1 with a single profile, 0 for ``und``."""
    ddl = "doc_id long, lang_pred string, score double"
    shared = docs.sparkSession.sparkContext.broadcast(learned)  # size entries a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = list(shared.value)
        codes = np.unique(np.concatenate([np.array(v, np.int64) for v in shared.value.values()])) if names else np.empty(0, np.int64)
        places = np.full((len(names), len(codes) + 1), -1, np.int64)
        for i, name in enumerate(names):
            places[i, np.searchsorted(codes, np.array(shared.value[name], np.int64))] = np.arange(len(shared.value[name]))
        for batch in batches:
            langs, scores = [], []
            for text in batch.column(1):
                own = ranked(*ngrams(text.as_py() or ""), size)
                if not len(own) or not names:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                at = np.searchsorted(codes, own)
                at[codes[np.minimum(at, len(codes) - 1)] != own] = len(codes)
                place = places[:, at]
                far = np.where(place < 0, size, np.abs(place - np.arange(len(own)))).sum(axis=1)
                order = np.argsort(far, kind="stable")
                best, second = far[order[0]], far[order[1]] if len(order) > 1 else None
                langs.append(names[order[0]])
                scores.append(1.0 if second is None or best == 0 < second else 0.5 if best == second else float(second / (best + second)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], schema=arrow_type(ddl))

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, ddl)
