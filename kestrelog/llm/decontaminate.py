"""Operator 2: benchmark decontamination by pigeonhole edit matching.

A test item of L characters may be off by k = floor(rate * L) edits. It is cut into k + 1 pieces: a
passage within k edits of it holds at least one piece unchanged. Exact piece hits (an Aho-Corasick
automaton over all pieces of a block of items) give windows of the document; Myers' bit-parallel
distance verifies each.

Both sides are compared lower-cased and with white space runs as one space. Null and empty texts hold
no item; empty items are found nowhere; an item too short for an edit must occur exactly, bounded by
non-letters. An item is its item_id and its text: several texts under one item_id are all searched for,
and it counts once, with the best match; items without an id are one item, without a number in item_ids.
Every row gives one row, repeated ids and null ids too, however many items there are. Extra columns are
ignored.
"""

from __future__ import annotations

import itertools
import uuid
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelog.llm.common import kept, map_rows, materialize

#: Items and characters of the query set that one pass over the documents holds in memory.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 8_000_000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def myers(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """Least distance of ``pattern`` to a substring of ``text``, and its last position, if <= most.

    Myers' bit vectors with the whole pattern as one word (Python's integers are that wide); a
    substring may begin and end anywhere.
    """
    m = len(pattern)
    peq: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        peq[c] |= 1 << i
    ones, last = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, at = ones, 0, m, most + 1, -1
    get = peq.get
    for j, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & ones)
        mh = pv & xh
        if ph & last:
            score += 1
        elif mh & last:
            score -= 1
        ph <<= 1
        pv = ((mh << 1) | ~(xv | ph)) & ones
        mv = ph & xv
        if score < best:
            best, at = score, j
    return (best, at) if best <= most else None


class Matcher:
    """Finds items within their error budget in normalised texts."""

    def __init__(self, items: list[tuple[int | None, str | None]], rate: float):
        own = dict.fromkeys((i, t) for i, text in items if (t := normal(text)))
        self.ids = [i for i, _ in own]
        self.items = [(t, int(rate * len(t))) for _, t in own]
        self.automaton = ahocorasick.Automaton()
        pieces = defaultdict(list)
        for i, (t, k) in enumerate(self.items):
            cuts = [j * len(t) // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces[t[a:b]].append((i, a))
        for piece, owners in pieces.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if pieces:
            self.automaton.make_automaton()

    def find(self, text: str) -> dict[int | None, tuple[int, int]]:
        """item_id -> (distance, end position in the normalised text), the least distance and first end."""
        starts: dict[int, list[int]] = defaultdict(list)
        if not self.items or not text:
            return {}
        for end, (size, owners) in self.automaton.iter(text):
            for i, offset in owners:
                starts[i].append(end + 1 - size - offset)
        found: dict[int | None, tuple[int, int]] = {}

        def add(i, hit):
            own = self.ids[i]
            found[own] = min(found.get(own, hit), hit)

        for i, at in starts.items():
            item, k = self.items[i]
            if k == 0:
                for a in sorted(at):
                    b = a + len(item)
                    if not (text[a - 1 : a].isalnum() or text[b : b + 1].isalnum()):
                        add(i, (0, b))
                        break
                continue
            at = sorted(set(at))
            low = at[0]
            for here, after in zip(at, [*at[1:], None]):
                # windows of starts that lie close together are verified as one
                if after is not None and after - here <= 2 * k:
                    continue
                a = max(0, low - k)
                if hit := myers(item, text[a : here + len(item) + k], k):
                    add(i, (hit[0], a + hit[1] + 1))
                low = after
        return found


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, one block at the driver at a time."""
    block, chars = [], 0
    for row in benchmark.selectExpr("cast(item_id as long) item_id", "text").dropDuplicates().toLocalIterator():
        if row.text is None:
            continue
        if block and (len(block) >= BLOCK_ITEMS or chars + len(row.text) > BLOCK_CHARS):
            yield block
            block, chars = [], 0
        block.append((row.item_id, row.text))
        chars += len(row.text)
    yield block


def _scan(docs: DataFrame, block: list, rate: float, carry: bool = False) -> DataFrame:
    """doc_id, hits ("item:distance:end" by item, comma-joined) and, with ``carry``, row."""
    shared, key = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = kept("matcher", key, lambda: Matcher(shared.value, rate))
        for batch in batches:
            hits = []
            for text in batch.column(1):
                found = sorted(matcher.find(normal(text.as_py())).items(), key=lambda x: (x[0] is not None, x))
                hits.append(",".join(f"{'' if i is None else i}:{d}:{e}" for i, (d, e) in found))
            columns = [batch.column(0), pa.array(hits, pa.string()), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "hits", "row"][: len(columns)])

    return map_rows(docs, run, "doc_id long, hits string", carry)


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = 0.08) -> DataFrame:
    """The documents that hold no item, with their columns; narrow maps only, each block a table of its own
    so that a task holds one automaton."""
    blocks = _blocks(benchmark)
    block = next(blocks)
    while True:
        docs = _scan(docs, block, rate, carry=True).filter("hits = ''").select("row.*")
        if (block := next(blocks, None)) is None:
            return docs
        docs = materialize(docs, "clean")


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.08) -> DataFrame:
    """One row per document: doc_id, n_items, item_ids (ascending, comma-joined), min_distance (null if
    none), ends (end of each match in the normalised text). Each block of items is broadcast, its size
    bounded by BLOCK_ITEMS and BLOCK_CHARS. Documents stay where they are; with several blocks what later
    ones find, few rows, comes back by (doc_id, hash of the text), on which it depends alone."""
    blocks = _blocks(benchmark)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        hits = _scan(docs, first, rate)
    else:
        texts, found = docs.select("doc_id", "text", F.xxhash64("text").alias("own")), None
        for block in itertools.chain([first, second], blocks):
            part = _scan(texts, block, rate, carry=True).filter("hits <> ''").select("doc_id", "row.own", "hits")
            part = materialize(part.distinct(), "hits")
            found = part if found is None else found.union(part)
        found = found.groupBy(F.col("doc_id").alias("d"), F.col("own").alias("o")).agg(F.concat_ws(",", F.collect_list("hits")).alias("hits"))
        every = texts.select(F.col("doc_id").cast("long").alias("doc_id"), "own")
        hits = every.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("own").eqNullSafe(F.col("o")), "left").select("doc_id", F.coalesce("hits", F.lit("")).alias("hits"))
    each = F.when(F.col("hits") == "", F.array().cast("array<string>")).otherwise(F.split("hits", ","))
    parts = F.transform(F.transform(each, lambda x: F.split(x, ":")), lambda x: F.struct(F.nullif(x[0], F.lit("")).cast("long").alias("i"), x[1].cast("long").alias("d"), x[2].cast("long").alias("e")))
    out = hits.select("doc_id", F.array_sort(parts).alias("all"))
    # an item with texts in several blocks counts once, with its best match
    out = out.select("doc_id", F.filter("all", lambda x, k: (k == 0) | ~x["i"].eqNullSafe(F.get("all", k - 1)["i"])).alias("h"))
    return out.select(
        "doc_id",
        F.size("h").cast("long").alias("n_items"),
        F.concat_ws(",", F.col("h.i").cast("array<string>")).alias("item_ids"),
        F.array_min("h.d").alias("min_distance"),
        F.concat_ws(",", F.col("h.e").cast("array<string>")).alias("ends"),
    )
