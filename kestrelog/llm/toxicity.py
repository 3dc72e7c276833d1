"""Operator 4: toxicity by noisy-channel deobfuscation.

A word that isn't plain letters (leetspeak, digits and signs at its ends, inside or alone), one with
repeated letters, and a run of single letters set apart by any blanks or signs (where words may end) are
character lattices: each place offers the letters it may stand for, at a cost. A Viterbi search over
trigram states finds the reading that a character language model likes best. The model is the exact
counts of all letter trigrams of all documents: it grows with what they hold. Letters without case, of
scripts that nobody writes in leetspeak, are one letter to it, so its size is bounded by the trigrams of
the cased alphabets that occur. The restored words are then scored by a logistic model over words and
word beginnings, learned from labelled rows; its weights are not negative, so a word speaks for toxicity
or not at all, and no wealth of harmless words outweighs a toxic one.

Null and empty texts have no words and get the model's base score. Labels that are null or whose
document is missing teach nothing; without labels of both classes every score is 0. Repeated rows get
equal scores; extra columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrelog.llm.common import Memo, arrow_type, kept, map_rows, materialize
from kestrelog.llm.langid import LETTER, _points

#: Letters that a sign may stand for (fixed values).
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "¡": "i"}
#: Costs of the channel, in nats.
SWAP, DROP, DROP_SIGN, DOUBLED, REPEATED, BREAK = 1.0, 8.0, 1.0, 5.0, 0.5, 3.0
#: Labelled rows of each class that the classifier is fitted on, at most, and its features.
SAMPLE, FEATURES = 6000, 2048
#: Least chi-square statistic of a feature.
CHI = 12.0


#: Letters numbered below this are counted in a plain array: the Latin ones of most texts.
FEW = 64


@cache
def alphabet() -> np.ndarray:
    """Number of each code point: 0 for what is no letter (a word's end), 1 for letters without case, and
    each lower-case letter its own from 2, in order."""
    out, n = (LETTER != 0).astype(np.int64), 2
    for i in np.flatnonzero(LETTER).tolist():
        c = chr(i)
        if c.lower() == c != c.upper():
            out[i], n = n, n + 1
    return out


def language_model(docs: DataFrame) -> dict[str, np.ndarray]:
    """Counts of letter trigrams over all texts, and of the two letters that they begin with: tri and bi,
    ascending codes of 12 bits a letter, with tri_n and bi_n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, few = alphabet(), np.zeros(FEW**3, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):  # a part at a time bounds the memory
                a = np.concatenate([numbers[_points(t.as_py() or "")] for t in batch.column(0).slice(at, 200)])
                x, y, z = a[:-2], a[1:-1], a[2:]
                real = ((x != 0) | (y != 0)) & ((y != 0) | (z != 0))  # not from one text to the next
                plain = real & (np.maximum(np.maximum(x, y), z) < FEW)
                few += np.bincount((x[plain] * FEW + y[plain]) * FEW + z[plain], minlength=len(few))
                other = real & ~plain
                codes, n = np.unique((x[other] << 24) | (y[other] << 12) | z[other], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n.astype(np.int64))], names=["code", "n"])
        at = np.flatnonzero(few)
        yield pa.RecordBatch.from_arrays([pa.array((at // FEW**2 << 24) | (at // FEW % FEW << 12) | at % FEW), pa.array(few[at])], names=["code", "n"])

    rows = docs.select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    tri, n = rows.column("code").to_numpy(), rows.column("n").to_numpy()
    order = np.argsort(tri)
    tri, n = tri[order], n[order]
    bi, first = np.unique(tri >> 12, return_index=True)
    return {"tri": tri, "tri_n": n, "bi": bi, "bi_n": np.add.reduceat(n, first) if len(n) else n}


def _count(codes: np.ndarray, counts: np.ndarray, code: int) -> int:
    at = int(np.searchsorted(codes, code))
    return int(counts[at]) if at < len(codes) and codes[at] == code else 0


class Restorer:
    """Words of a text with obfuscated ones restored."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.counts, self.numbers = counts, alphabet()
        self.costs = Memo(self._cost, 100_000)
        signs = re.escape("".join(c for c in LEET if not c.isalnum()))
        self.run = re.compile(r"(.)\1*", re.S)
        one = rf"(?:[^\W_]|[{signs}])"
        self.spaced = re.compile(rf"(?<![^\W_]){one}(?:(?:[^\w{signs}]|_)+{one}){{2,}}(?![^\W_])").findall
        self.between = re.compile(rf"(?:[^\w{signs}]|_)+")
        self.spans = Memo(self._span, 50_000)
        self.repeated = re.compile(r"(.)\1").search
        self.ends = re.compile(r"^[^\w@$]+|(?<=.)[^\w]+$|^[^\w]+$")
        self.edges = re.compile(rf"^[^\w{signs}]+|[^\w{signs}]+$")

    def _cost(self, key: tuple[str, str, str]) -> float:
        a, b, c = (int(self.numbers[ord(x)]) for x in key)
        m, two = self.counts, a << 12 | b
        return float(-np.log((_count(m["tri"], m["tri_n"], two << 12 | c) + 0.1) / (_count(m["bi"], m["bi_n"], two) + 4.0)))

    def lattice(self, word: str, pause: float | None = None) -> Iterator[list[tuple[str, float]]]:
        """What each place may stand for, at what cost. With ``pause``, the cost of one, a blank may follow
        each letter."""
        for found in self.run.finditer(word):
            c, n = found[1], len(found[0])
            if c.isalpha():
                options = [(c, 0.0)] if n == 1 else [(c + c, 0.0), (c, DOUBLED)] if n == 2 else [(c, REPEATED), (c + c, REPEATED)]
            elif c in LEET:
                options = [(x, SWAP) for x in LEET[c]] + [("", DROP)] + [(x + x, SWAP) for x in LEET[c] if n > 1]
            else:
                options = [("", DROP_SIGN)]
            if pause is not None:
                options += [(x + " ", price + pause) for x, price in options if x and found.end() < len(word)]
            yield options

    def decode(self, word: str, pause: float | None = None) -> str:
        """The cheapest reading of a lattice; states are the last two letters."""
        states = {(" ", " "): (0.0, "")}
        costs = self.costs
        for options in self.lattice(word, pause):
            after: dict = {}
            for state, (cost, text) in states.items():
                for more, price in options:
                    (a, b), total = state, cost + price
                    for x in more:
                        total += costs[a, b, x]
                        a, b = b, x
                    old = after.get((a, b))
                    if old is None or total < old[0]:
                        after[a, b] = (total, text + more)
            states = after
        return min((cost + costs[a, b, " "], text) for (a, b), (cost, text) in states.items())[1]

    def _span(self, letters: str) -> list[str]:
        """Words of spaced-out letters; the first and the last may be one-letter words beside them."""
        parts = {x for x in (letters, letters[1:], letters[:-1], letters[1:-1]) if len(x) > 2}
        return sorted({word for part in parts for word in self.decode(part, BREAK).split()})

    def word(self, chunk: str) -> str:
        """The restored word of a lower-case chunk without blanks; empty if nothing in it may be a letter."""
        if not chunk.isalpha():
            chunk = self.ends.sub("", chunk)
        if chunk.isalpha() and not self.repeated(chunk):
            return chunk
        return self.decode(chunk) if any(c.isalpha() or c in LEET for c in chunk) else ""

    def readings(self, chunk: str) -> set[str]:
        """The restored word without signs at its ends, and what the chunk spells if they are letters."""
        found = {self.word(chunk)}
        core = self.edges.sub("", chunk)
        if core and not core.isalpha() and not (core[0].isalnum() and core[-1].isalnum()):
            found.add(self.decode(core))
        return found

    def words(self, text: str) -> Iterator[str]:
        """Distinct chunks of the text, then the words that its spaced-out letters spell."""
        text = text.lower()
        yield from set(text.split())
        for span in self.spaced(text):
            yield from self.spans[self.between.sub("", span)]


def features(word: str) -> list[int]:
    """Keys of a restored word: itself and how it begins."""
    if len(word) < 3:
        return []
    names = [word] + ["^" + word[:4]] * (len(word) > 4) + ["^" + word[:5]] * (len(word) > 5)
    return [xxhash.xxh3_64_intdigest(name) >> 1 for name in names]


def _fit(rows: list[list[int]], labels: np.ndarray, size: int, l2: float = 5e-5, steps: int = 400) -> np.ndarray:
    """Weights and, last, the bias of a logistic model over sets of features; three tenths of the weight on toxic rows."""
    r = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    c = np.array([i for x in rows for i in x], np.int64)
    share = np.where(labels == 1, 0.3 / max(1, labels.sum()), 0.7 / max(1, (1 - labels).sum()))
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        z = np.bincount(r, weights=w[c], minlength=len(rows)) + w[-1]
        error = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels)
        g = np.append(np.bincount(c, weights=error[r], minlength=size) + l2 * w[:-1], error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w[:-1] = np.maximum(w[:-1], 0.0)  # features speak for toxicity or not at all
    return w


def fit(docs: DataFrame, labels: DataFrame, training: Column, sample: int = SAMPLE, size: int = FEATURES) -> dict:
    """The model: language model counts over all documents; features and weights from at most ``sample``
    labelled rows of each class for which ``training`` (a condition on doc_id) holds, in hash order."""
    spark = docs.sparkSession
    counts = language_model(docs)
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null").filter(training)
    chosen = None
    for label in (0, 1):
        part = rows.filter(F.col("toxic") == label).dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.union(part)
    shared = spark.sparkContext.broadcast(counts)
    ddl = "toxic int, keys binary"

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(shared.value)
        known = Memo(lambda chunk: [k for word in restorer.readings(chunk) for k in features(word)], 200_000)
        for batch in batches:
            keys = []
            for text in batch.column(1):
                found = set()
                for chunk in restorer.words(text.as_py() or ""):
                    found.update(known[chunk])
                keys.append(np.array(sorted(found), np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary())], schema=arrow_type(ddl))

    # 2 * sample rows of two numbers: small enough for every executor
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text")
    train = materialize(texts.mapInArrow(describe, ddl), "train")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs, toxic = batch.column(1).to_pylist(), batch.column(0).to_numpy()
            keys, where = np.unique(np.frombuffer(b"".join(blobs), np.int64), return_inverse=True)
            of = np.repeat(toxic, [len(b) // 8 for b in blobs])
            n = [np.bincount(where, weights=of == k, minlength=len(keys)).astype(np.int64) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n[0]), pa.array(n[1])], names=["key", "clean", "toxic"])

    sizes = {row.toxic: row["count"] for row in train.groupBy("toxic").count().collect()}
    model = {"counts": counts, "keys": [], "weights": np.zeros(0), "bias": None}
    if not (sizes.get(0) and sizes.get(1)):
        return model
    seen = train.mapInArrow(tally, "key long, clean long, toxic long").groupBy("key").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    gap = F.col("toxic") / sizes[1] - F.col("clean") / sizes[0]
    spread = (F.col("toxic") + F.col("clean") + 1) / (sizes[0] + sizes[1])
    fit = gap * gap / spread * (sizes[0] * sizes[1] / (sizes[0] + sizes[1]))  # about chi-square
    best = seen.filter((gap > 0) & (F.col("toxic") > 1)).withColumn("fit", fit).filter(F.col("fit") >= CHI).orderBy(F.desc("fit"), "key").limit(size)
    keys = sorted(row.key for row in best.select("key").collect())
    index = {key: i for i, key in enumerate(keys)}

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [[index[k] for k in np.frombuffer(b, np.int64).tolist() if k in index] for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.int32()))], names=["toxic", "own"])

    held = train.mapInArrow(select, "toxic int, own array<int>").collect()  # 2 * sample rows at most
    w = _fit([row.own for row in held], np.array([row.toxic for row in held], float), len(keys))
    return model | {"keys": keys, "weights": w[:-1], "bias": float(w[-1])}


def score(docs: DataFrame, model: dict, threshold: float = 0.7, carry: bool = False) -> DataFrame:
    """doc_id, score, predicted, and with ``carry`` the whole input row as the struct ``row``; a narrow
    map over whole texts."""
    shared, run_key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value

        def make():
            restorer, index = Restorer(m["counts"]), {key: i for i, key in enumerate(m["keys"])}
            return restorer, Memo(lambda chunk: tuple(index[k] for word in restorer.readings(chunk) for k in features(word) if k in index), 200_000)

        restorer, known = kept("toxicity", run_key, make)
        weights = m["weights"].tolist()
        for batch in batches:
            scores = []
            for text in batch.column(1):
                if m["bias"] is None:
                    scores.append(0.0)
                    continue
                hits = {i for found in map(known.__getitem__, restorer.words(text.as_py() or "")) if found for i in found}
                z = m["bias"] + sum(weights[i] for i in sorted(hits))
                scores.append(float(1 / (1 + np.exp(-min(max(z, -30.0), 30.0)))))
            columns = [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "predicted", "row"][: len(columns)])

    return map_rows(docs, run, "doc_id long, score double, predicted int", carry)
