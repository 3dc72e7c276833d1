"""Operator 3: n-gram Jaccard join by universe-partition pigeonhole.

A document is the set of hashes of its word shingles. Sizes fall into bands; each band has a plan that
deals the universe of hashes into segments. Two sets over the threshold differ in at most H elements,
so among segments worth more than H in sum at least one agrees: an exact segment (worth 1) agrees if it
holds the same elements, a one-deletion segment (worth 2) if it does after taking out at most one on
either side. Signatures of the segment subsets are the index; segments of fewer than two elements are
left out of it wherever the others alone are worth enough. How many segments, and which kind, is the
cheapest plan of a cost model over the number of documents.

Candidates: a signature's rows are linked to its smallest document (first per batch, then per
signature), never pair by pair. Links are verified exactly, from the sets. Where a signature's documents
then lie in several components, a second round links one document of each to one of the largest there,
drawn anew by each signature. What still lies in several components gives all pairs across components
that a 1024-bit parity sketch (an exact lower bound of the difference) doesn't rule out, and those are
verified as well: components lose no link.

Null and empty texts have an empty set and no links. A text with fewer words than a shingle is one
shingle. Rows with one doc_id are one document: it links by each of its texts, and each row tells the size
of its own set. A row without doc_id has nulls and links nothing. Extra columns are ignored.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelog.llm.common import Memo, arrow_type, components, kept, materialize, modest_batches, release, remove, sieve

U64 = np.uint64
GOLD = 0x9E3779B97F4A7C15
#: What the cost model takes a related pair to share.
OVERLAP = 0.25
#: 64-bit words of a parity sketch.
WORDS = 16
SKETCH = [f"s{i}" for i in range(WORDS)]
#: Signatures that a task holds before it links and passes them on.
HELD = 500_000
#: Bits of a signature.
KEY_BITS = 48


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer over an array of uint64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _salt(*parts: int) -> np.uint64:
    return U64(xxhash.xxh3_64_intdigest(repr(parts).encode()))


class Shingler:
    """Distinct hashes of the ``width``-word shingles of a text; words are runs without ASCII white space."""

    def __init__(self, width: int, limit: int = 300_000):
        self.width = width
        self.words = Memo(xxhash.xxh3_64_intdigest, limit)
        self.factors = [_salt(width, i) | U64(1) for i in range(width)]

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()  # bytes.lower() knows A-Z only
        if not words:
            return np.empty(0, U64)
        if len(words) < self.width:
            return np.array([xxhash.xxh3_64_intdigest(b"\0".join(words), seed=len(words))], U64)
        h = np.fromiter(map(self.words.__getitem__, words), U64, len(words))
        n = len(words) - self.width + 1
        total = np.zeros(n, U64)
        for i, factor in enumerate(self.factors):
            total += mix(h[i : i + n] * factor + factor)
        return np.unique(mix(total))


class Plans:
    """Size bands and their plans for Jaccard >= percent / 100 over about ``documents`` sets."""

    def __init__(self, percent: int, documents: int, chance: float = 0.001):
        self.percent, self.documents, self.chance = percent, max(1, documents), chance
        self.edges = [1]
        ratio = max(100 / percent, 1.3)
        while self.edges[-1] < 1 << 40:
            self.edges.append(max(self.edges[-1] + 1, int(self.edges[-1] * ratio)))
        self.plan = cache(self._plan)

    def band(self, size: int) -> int:
        return int(np.searchsorted(self.edges, size, side="right")) - 1

    def bands(self, size: int) -> range:
        """Bands in which a set is a key: its own, and those of its smallest partners."""
        return range(self.band(-(-self.percent * size // 100)), self.band(size) + 1)

    def budget(self, band: int) -> int:
        """Most elements in which a set of this band and a partner of its size or more can differ."""
        low = self.edges[band + 1] - 1
        most = low + low * 100 // self.percent
        return max(0, *(s - 2 * -(-self.percent * s // (100 + self.percent)) for s in (most, most - 1)))

    def _plan(self, band: int) -> tuple[int, int, int, int]:
        """(segments, of which one-deletion, elements that an exact segment must have, units needed).

        The cheapest by signatures a set plus false candidates: ``chance`` is the part of all pairs that
        have anything in common, as by a shared passage, and OVERLAP how much.
        """
        low, high, units = self.edges[band], self.edges[band + 1] - 1, self.budget(band) + 1
        best = None
        for deletions in sorted({0, units // 2, *range(0, units // 2 + 1, max(1, units // 16))}):
            need = units - 2 * deletions
            for least in (2, 1, 0):
                for extra in (0.0, 0.03, 0.06, 0.1, 0.2, 0.35, 0.5) if least else (0.0,):
                    exact = need + math.ceil(extra * need)
                    m = max(1, exact + deletions)
                    t = low / m
                    odds = [math.exp(-t) * t**j / math.factorial(j) for j in range(8)]
                    share = 1 - sum(odds[:least])
                    if least and share * exact - 2 * math.sqrt(share * (1 - share) * exact) < need:
                        continue
                    alone = self.chance * math.exp(-t * (1 - OVERLAP))
                    alike = sum(alone * p * OVERLAP**j if j else p * p for j, p in enumerate(odds) if j >= least)
                    near = (1 + t) ** 2 * (odds[0] ** 2 + sum(alone * p * OVERLAP ** max(0, j - 1) for j, p in enumerate(odds)))
                    cost = share * exact + deletions * (high / m + 1) + self.documents * (exact * alike + deletions * near)
                    if best is None or cost < best[0]:
                        best = cost, (m, deletions, least, units)
        return best[1]

    def signatures(self, items: np.ndarray) -> np.ndarray:
        """Keys of KEY_BITS bits of the segment subsets of a set; they propose candidates, no more."""
        out = []
        for band in self.bands(len(items)) if len(items) else ():
            m, deletions, least, units = self.plan(band)
            salt = _salt(self.percent, band)
            own = mix(items + salt)
            segment = ((own >> U64(32)) * U64(m) >> U64(32)).astype(np.int64)
            sums, counts = np.zeros(m, U64), np.bincount(segment, minlength=m)
            np.add.at(sums, segment, own)
            keys = mix(sums + np.arange(1, m + 1, dtype=U64) * U64(GOLD) + salt)
            exact = keys[deletions:]
            if least:
                strong = counts[deletions:] >= least
                if int(strong.sum()) + 2 * deletions >= units:
                    exact = exact[strong]
            out.append(exact)
            if deletions:
                inside = segment < deletions
                where = segment[inside]
                out.append(keys[:deletions])
                out.append(mix(sums[where] - own[inside] + (where + 1).astype(U64) * U64(GOLD) + salt))
        return np.unique(np.concatenate(out) >> U64(64 - KEY_BITS)) if out else np.empty(0, U64)


def planes(a: np.ndarray) -> bytes:
    """An array of 64-bit numbers by byte planes, so that zero bytes compress away."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(-1, 8).T.tobytes()


def unplaned(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(np.frombuffer(data, np.uint8).reshape(8, -1).T.tobytes(), kind)


def _stars(keys: np.ndarray, rows: np.ndarray):
    """Of parallel arrays: (keys, smallest row of each key) and the edges (key, smallest, other)."""
    order = np.lexsort((rows, keys))
    keys, rows = keys[order], rows[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    hub = rows[first][np.cumsum(first) - 1] if len(keys) else rows
    other = ~first & (hub != rows)
    return keys[first], rows[first], (keys[other], hub[other], rows[other])


def _index(docs: DataFrame, width: int, percent: int, documents: int, chance: float, parts: int) -> DataFrame:
    """Rows about documents (sig null): doc_id, n, fingerprint f1 f2, parity sketch s0 to s15; and star
    edges (sig, a, b) from each signature's smallest document to the others that have it.

    A task links a part of its rows first and passes on one row per signature, as sorted and differenced
    keys; what is known of its documents travels along. So a hot signature reaches the task that
    owns it once per part.
    """
    slots = 4 * parts
    packed = "slot int, base long, keys binary, rows binary, es binary, ea binary, eb binary, docs binary"
    about = 4 + WORDS  # numbers of a document row

    def cut(keys: np.ndarray) -> np.ndarray:
        return np.searchsorted(keys, (np.arange(slots + 1, dtype=np.float64) * (2.0**KEY_BITS / slots)).astype(U64))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, plans, schema = kept("shingler", width, lambda: Shingler(width)), Plans(percent, documents, chance), arrow_type(packed)
        slot, ids, known, sigs, held = 0, [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal slot
            base = min(ids)
            rows = np.repeat(np.array(ids, np.int64), [len(x) for x in sigs])
            keys, rows, edges = _stars(np.concatenate(sigs), rows)
            a, e = cut(keys), cut(edges[0])
            out = []
            for k in range(slots):
                if a[k + 1] > a[k]:
                    part, links = slice(a[k], a[k + 1]), slice(e[k], e[k + 1])
                    out.append((k, base, planes(np.diff(keys[part], prepend=U64(0))), planes(rows[part] - base), planes(edges[0][links]), planes(edges[1][links] - base), planes(edges[2][links] - base), b""))
            for at in range(0, len(known), 200):
                slot = (slot + 1) % slots
                out.append((slot, base, b"", b"", b"", b"", b"", np.concatenate(known[at : at + 200]).tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                items = shingle(text.as_py())
                bits = np.bincount((items & U64(64 * WORDS - 1)).astype(np.int64), minlength=64 * WORDS).astype(np.uint8) & 1
                prints = np.array([mix(items + U64(1)).sum(dtype=U64), mix(items + U64(GOLD)).sum(dtype=U64)], U64)
                known.append(np.concatenate([np.array([doc_id, len(items)], np.int64), prints.view(np.int64), np.packbits(bits).view(np.int64)]))
                ids.append(doc_id)
                sigs.append(plans.signatures(items))
                held += len(sigs[-1])
                if held >= HELD or len(ids) >= HELD // 50:  # a part of the batch at a time bounds the memory
                    yield flush()
                    ids, known, sigs, held = [], [], [], 0
        if ids:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_type(INDEX_DDL)
        keys, rows, es, ea, eb = [np.empty(0, U64)], *([np.empty(0, np.int64)] for _ in range(4))

        def edges_of(s, a, b):
            for at in range(0, len(s), 50_000):
                part = slice(at, at + 50_000)
                columns = [pa.array(x[part].astype(np.int64)) for x in (s, a, b)]
                yield pa.RecordBatch.from_arrays(columns + [pa.nulls(len(columns[0]), pa.int64())] * about, schema=schema)

        for batch in batches:
            for r in batch.to_pylist():
                if r["docs"]:
                    known = np.frombuffer(r["docs"], np.int64).reshape(-1, about)
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(known), pa.int64())] * 3 + [pa.array(known[:, i].copy()) for i in range(about)], schema=schema)
                if r["keys"]:
                    keys.append(np.cumsum(unplaned(r["keys"], U64), dtype=U64))
                    rows.append(unplaned(r["rows"], np.int64) + r["base"])
                if r["es"]:
                    yield from edges_of(unplaned(r["es"], np.int64), unplaned(r["ea"], np.int64) + r["base"], unplaned(r["eb"], np.int64) + r["base"])
        _, _, edges = _stars(np.concatenate(keys), np.concatenate(rows))
        yield from edges_of(*edges)

    source = docs.selectExpr("cast(doc_id as long) doc_id", "text").filter("doc_id is not null")
    dealt = source.mapInArrow(local, packed).repartition(parts, "slot")
    return dealt.mapInArrow(meet, INDEX_DDL)


INDEX_DDL = "sig long, a long, b long, doc_id long, n long, f1 long, f2 long, " + ", ".join(f"s{i} long" for i in range(WORDS))


def _apart(p: str, q: str) -> F.Column:
    return reduce(operator.add, [F.bit_count(F.col(f"{p}.{s}").bitwiseXOR(F.col(f"{q}.{s}"))) for s in SKETCH])


def _possible(p: str, q: str, percent: int) -> F.Column:
    """Neither the sizes nor the sketches rule the pair out."""
    total = F.col(f"{p}.n") + F.col(f"{q}.n")
    most = total - 2 * F.ceil(total * percent / F.lit(100.0 + percent) - 1e-9)
    return (_apart(p, q) <= most) & (F.abs(F.col(f"{p}.n") - F.col(f"{q}.n")) <= most)


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, keep = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], names=["a", "b"])

    left, right = sets.select(F.col("doc_id").alias("a"), F.col("items").alias("x")), sets.select(F.col("doc_id").alias("b"), F.col("items").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _labelled(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """sig, doc_id, component of the documents of each signature (its smallest one repeats)."""
    rows = edges.select("sig", F.explode(F.array("a", "b")).alias("doc_id"))
    return rows.join(labels, rows.doc_id == labels.node, "left").select("sig", "doc_id", F.coalesce("component", "doc_id").alias("component"))


def _across_stars(rows: DataFrame, small: DataFrame, percent: int) -> DataFrame:
    """Candidates (a, b): one document of each component of a signature and one of that component which
    has the most rows there. Which one is drawn by signature and document, so that the signatures of two
    components propose different pairs; at most one pair for each signature and component."""
    drawn = F.min_by("doc_id", F.xxhash64("sig", "doc_id")).alias("doc_id")
    parts = rows.groupBy("sig", "component").agg(F.count("*").alias("size"), drawn)
    hubs = parts.groupBy("sig").agg(F.max(F.struct("size", "component", "doc_id")).alias("hub"), F.count("*").alias("several")).filter("several > 1")
    pairs = parts.join(hubs.select("sig", "hub"), "sig").filter("component <> hub.component")
    pairs = pairs.select(F.least("doc_id", "hub.doc_id").alias("a"), F.greatest("doc_id", "hub.doc_id").alias("b")).distinct()
    p, q = small.alias("p"), small.alias("q")
    joined = pairs.join(p, F.col("a") == F.col("p.doc_id")).join(q, F.col("b") == F.col("q.doc_id"))
    return joined.filter(_possible("p", "q", percent)).select("a", "b")


def jaccard_classes(docs: DataFrame, width: int = 5, percent: int = 80, chance: float = 0.001, documents: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id that links reach).

    ``width`` words a shingle; two sets link if 100 * intersection >= ``percent`` * union. ``documents``
    (the number of rows unless given) and ``chance`` feed the cost model only, never the result.
    """
    spark = docs.sparkSession
    modest_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    documents = docs.count() if documents is None else documents
    index = materialize(_index(docs, width, percent, documents, chance, parts), "index")
    release(spark)
    described = index.filter("sig is null").select("doc_id", "n", "f1", "f2", *SKETCH)
    small = described.filter("n > 0").dropDuplicates(["doc_id", "f1", "f2"])
    edges = index.filter("sig is not null").select("sig", "a", "b")

    pairs = edges.groupBy("a", "b").agg(F.lit(1).alias("one"))
    p, q = small.alias("p"), small.alias("q")
    joined = pairs.join(p, F.col("a") == F.col("p.doc_id")).join(q, F.col("b") == F.col("q.doc_id"))
    equal = (F.col("p.n") == F.col("q.n")) & (F.col("p.f1") == F.col("q.f1")) & (F.col("p.f2") == F.col("q.f2"))
    likely = materialize(joined.filter(_possible("p", "q", percent)).select("a", "b", equal.alias("equal")), "likely")

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = kept("shingler", width, lambda: Shingler(width))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())], names=["doc_id", "items"])

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """The links among a table of pairs. Only its documents' texts are shuffled and their sets written, and
        go with the shuffles: the larger the corpus, the more documents share some signature, but not the more
        of them are like others."""
        release(spark)
        if pairs.isEmpty():
            return pairs
        needed = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        texts = docs.selectExpr("cast(doc_id as long) doc_id", "text").filter(sieve(needed)("doc_id"))
        texts = texts.withColumn("t", F.xxhash64("text")).join(needed, "doc_id", "left_semi").dropDuplicates(["doc_id", "t"])
        sets = materialize(texts.select("doc_id", "text").mapInArrow(shingles, "doc_id long, items binary"), "items")
        release(spark)
        found = materialize(_verify(pairs, sets, percent), name)
        remove(spark, sets)
        release(spark)
        return found

    checked = verified(likely.filter("not equal").select("a", "b"), "checked")
    links = likely.filter("equal").select("a", "b").union(checked)
    labels = components(links, "labels")

    # few documents of a group may miss its smallest one: other members, a different one by each signature
    near = _across_stars(_labelled(edges, labels), small, percent).join(likely.select("a", "b"), ["a", "b"], "left_anti")
    near = materialize(near, "near")
    stars = verified(near, "stars")
    every = links
    if not stars.isEmpty():
        every = links.union(stars)
        remove(spark, labels)
        labels = components(every, "labels1")
    release(spark)

    # signatures whose documents still lie in several components
    rows = _labelled(edges, labels)
    mixed = rows.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    mixed = mixed.filter("low <> high").select("sig")
    # of rows with equal sets in one component one is enough
    groups = rows.join(mixed, "sig").join(small, "doc_id")
    groups = groups.groupBy("sig", "component", "n", "f1", "f2").agg(F.min("doc_id").alias("doc_id"), *[F.first(s).alias(s) for s in SKETCH])
    groups = materialize(groups, "groups")
    p, q = groups.alias("p"), groups.alias("q")
    across = p.join(q, (F.col("p.sig") == F.col("q.sig")) & (F.col("p.component") < F.col("q.component")) & _possible("p", "q", percent))
    across = across.select(F.least("p.doc_id", "q.doc_id").alias("a"), F.greatest("p.doc_id", "q.doc_id").alias("b")).distinct()
    across = across.join(likely.select("a", "b"), ["a", "b"], "left_anti")
    across = materialize(across, "across")
    more = verified(across, "links2")
    if more.isEmpty():
        final = labels
    else:
        final = components(every.union(more), "labels2")
        remove(spark, labels)
    known = materialize(described.select("doc_id", F.col("n").alias("n_shingles")), "sizes")
    for done in (index, likely, checked, near, stars, groups, across, more):  # what the result doesn't read
        remove(spark, done)
    nameless = docs.filter("doc_id is null").select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n_shingles"))
    out = known.union(nameless).join(final, F.col("doc_id") == F.col("node"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
