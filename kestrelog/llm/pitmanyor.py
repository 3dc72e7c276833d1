"""Operator 12: language-model scores by a hierarchical Pitman-Yor model.

Every word is the context of one restaurant, whose dishes are the words that follow it; all of them share
one parent, the restaurant of single words, whose own parent is uniform. A dish's first customers open
tables, and each table is a customer of the parent. Gibbs sampling re-seats, one after another, all
customers of a dish in a restaurant: the number of their tables is drawn from its conditional, given the
tables of the whole restaurant and the parent's probability. Up to 64 customers that is exact, by
generalised Stirling numbers; a larger group is seated by the predictive rule in growing blocks, of which
mean and variance are followed. A dish of one customer has one table always, so only its count takes part.
Strengths follow by their expected auxiliary counts after each sweep, discounts from counts of counts.
Predictive probabilities are averaged over the sweeps kept.

Texts become chunks of a bounded number of tokens. Words are counted by exact text in hash buckets, which
answer each chunk with word numbers; pairs of numbers are counted in buckets as well, which answer with
counts. A sweep joins pairs that stand more than once with the state of their context and their dish, so
neither a context nor the vocabulary is ever in one task or at the driver. Draws are hashes of pair and
sweep: a task that runs again draws the same.

Null texts are empty: one end token. Rows whose training condition is null are learned from. Repeated rows
count as often as they stand, very long texts are read whole (a text longer than a chunk is a chunk of its
own), an empty table gives no rows, without training rows every score is 0, and other columns are ignored.
At most 2^31 distinct words can be learned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrelog.llm.common import arrow_type, give_back, materialize, release, remove

#: Tokens of a chunk, and tokens of the table to a bucket.
CHUNK, BUCKET = 500_000, 2_000_000
#: Number of what stands before and after a text; unknown words have number 0.
EDGE = 1
#: Customers of one dish up to which the number of tables is drawn exactly.
EXACT = 64


def _bytes(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets, from 0, and the bytes of an array of binaries."""
    _, offsets, data = a.buffers()
    offsets = np.frombuffer(offsets, np.int32)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int32)
    held = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return offsets - offsets[0], held


def _places(words: pa.Array, buckets: int) -> np.ndarray:
    """A bucket for each word, by a polynomial of its bytes: equal words, wherever they stand, have one."""
    offsets, data = _bytes(words)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(len(data) + 1, 0x9E3779B97F4A7C15, np.uint64))
        sums = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[1:])]
        # the sum of a word that begins at k holds the factor power[k]; its inverse takes it away
        back = np.cumprod(np.full(len(data) + 1, pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64))
        value = (sums[offsets[1:]] - sums[offsets[:-1]]) * back[offsets[:-1]]
    return (_mix(value) % np.uint64(buckets)).astype(np.int64)


def _pack(**arrays) -> bytes:
    """Arrays of whole numbers and of binaries as one compressed block, after a line that says what it holds.
    Numbers are kept by byte planes, which pack better."""
    head, body = [], []
    for name, a in arrays.items():
        if isinstance(a, pa.Array):
            head.append(f"{name} bytes {len(a)}")
            offsets, data = _bytes(a)
            body += [np.diff(offsets).tobytes(), data.tobytes()]
            continue
        small = len(a) == 0 or (a.min() >= -(1 << 31) and a.max() < 1 << 31)
        a = np.ascontiguousarray(a, np.int32 if small else np.int64)
        head.append(f"{name} {a.dtype.str} {len(a)}")
        body.append(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes())
    return zstandard.compress(";".join(head).encode() + b"\n" + b"".join(body), 1)


def _unpack(data: pa.Scalar) -> dict:
    block, found = zstandard.decompress(data.as_buffer()), {}
    at = block.index(b"\n") + 1
    for part in block[: at - 1].decode().split(";"):
        name, kind, size = part.split(" ")
        size = int(size)
        if kind == "bytes":
            offsets = np.r_[np.int32(0), np.cumsum(np.frombuffer(block, np.int32, size, at), dtype=np.int32)]
            at += 4 * size
            end = at + int(offsets[-1])
            found[name] = pa.Array.from_buffers(pa.binary(), size, [None, pa.py_buffer(offsets), pa.py_buffer(block[at:end])])
        else:
            kind = np.dtype(kind)
            end = at + size * kind.itemsize
            planes = np.frombuffer(block, np.uint8, end - at, at).reshape(kind.itemsize, size)
            found[name] = np.ascontiguousarray(planes.T).view(kind).ravel()
        at = end
    return found


def _split(place: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The indices of each value of ``place``, rising."""
    order = np.argsort(place.astype(np.uint16) if len(place) and place.max() < 1 << 16 else place, kind="stable")
    values, first = np.unique(place[order], return_index=True)
    for value, a, b in zip(values.tolist(), first, [*first[1:], len(place)]):
        yield value, order[a:b]


def _rows(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    schema = arrow_type(ddl)
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _chunks(docs: DataFrame, learn: Column, size: int) -> DataFrame:
    """(chunk, tokens, train_tokens, train_docs, data): texts as numbers of the chunk's own words."""
    ddl = "chunk long, tokens long, train_tokens long, train_docs long, data binary"

    def chunk(number: int, parts: list[tuple]) -> pa.RecordBatch:
        ids, learned, lengths, values = zip(*parts)
        lengths, training, ids = np.concatenate(lengths), np.concatenate(learned), pa.concat_arrays(ids)
        found = pa.concat_arrays(values).dictionary_encode()
        tokens, words = found.indices.to_numpy(), found.dictionary.cast(pa.binary())
        often = np.argsort(-np.bincount(tokens, minlength=len(words)), kind="stable")
        place = np.empty(len(often), np.int32)
        place[often] = np.arange(len(often))  # frequent words get small numbers, which pack well
        tokens, words = place[tokens], words.take(pa.array(often))
        counts = np.bincount(tokens[np.repeat(training, lengths)], minlength=len(words))
        nameless = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int8)
        data = _pack(doc_id=ids.fill_null(0).to_numpy(), nameless=nameless, training=training.astype(np.int8), lengths=lengths, tokens=tokens, words=words, counts=counts)
        return _rows([(number, int(lengths.sum()) + len(lengths), int((lengths[training] + 1).sum()), int(training.sum()), data)], ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, tokens = TaskContext.get().partitionId() << 32, [], 0  # a task's chunks are written once, with the table
        for batch in batches:
            # both know ASCII alone: the one takes A-Z, the other the blank and \x09-\x0D
            lists = pc.ascii_split_whitespace(pc.ascii_lower(batch.column(2).fill_null("")))
            values, real = lists.flatten(), pc.not_equal(lists.flatten(), "").to_numpy(zero_copy_only=False)
            ends = np.r_[0, np.cumsum(real)][lists.offsets.to_numpy() - lists.offsets[0].as_py()]
            values, learned = values.filter(pa.array(real)), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            begin = 0
            while begin < batch.num_rows:  # rows up to the one that fills the chunk
                rows = np.arange(begin, batch.num_rows)
                full = np.flatnonzero(tokens + ends[rows + 1] - ends[begin] + rows + 1 - begin >= size)
                end = int(rows[full[0]]) + 1 if len(full) else batch.num_rows
                held.append((batch.column(0).slice(begin, end - begin), learned[begin:end], np.diff(ends[begin : end + 1]), values.slice(ends[begin], ends[end] - ends[begin])))
                tokens += int(ends[end] - ends[begin]) + end - begin
                begin = end
                if tokens >= size:
                    yield chunk(number, held)
                    number, held, tokens = number + 1, [], 0
        if held:
            yield chunk(number, held)
        held = lists = values = None
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(learn, F.lit(True)).alias("training"), "text")
    return materialize(rows.mapInArrow(run, ddl), "pitman-yor-chunks")


def _word_numbers(chunks: DataFrame, buckets: int) -> DataFrame:
    """(bucket, chunk, distinct, data): for each chunk the numbers and training counts of its words in a
    bucket. A row of its own, without a chunk, has the bucket's training words and how many they are.

    Numbers rise as counts fall, so they pack well: number = rank in the bucket * buckets + bucket + 2.
    """
    asked, answered = "bucket int, chunk long, data binary", "bucket int, chunk long, distinct long, data binary"

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                held = _unpack(data)
                for bucket, at in _split(_places(held["words"], buckets)):
                    yield _rows([(bucket, number, _pack(at=at, words=held["words"].take(pa.array(at)), counts=held["counts"][at]))], asked)
        give_back()

    def answer(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        held = [_unpack(data) for data in table.column("data")]
        words = pa.chunked_array([h["words"] for h in held]).combine_chunks().dictionary_encode()
        index, counts = words.indices.to_numpy(), np.concatenate([h["counts"] for h in held])
        total = np.bincount(index, weights=counts, minlength=len(words.dictionary)).astype(np.int64)
        rank = np.empty(len(total), np.int64)
        # equal counts in order of the word: the same numbers however the blocks arrive
        rank[np.lexsort((pc.rank(words.dictionary, sort_keys="ascending").to_numpy(), -total))] = np.arange(len(total))
        number = np.where(total > 0, rank * buckets + bucket + 2, 0)
        if len(number) and number.max() >= 1 << 31:
            raise ValueError("more than 2^31 distinct words")
        learned, begin = total > 0, 0
        rows = [(bucket, None, int(learned.sum()), _pack(number=number[learned], count=total[learned]))]
        for chunk, h in zip(table.column("chunk").to_pylist(), held):
            own = index[begin : begin + len(h["at"])]
            begin += len(h["at"])
            rows.append((bucket, chunk, None, _pack(at=h["at"], number=number[own], count=total[own])))
        held = words = index = counts = None
        give_back()
        return pa.Table.from_batches([_rows(rows, answered)])

    requests = chunks.select("chunk", "data").mapInArrow(ask, asked)
    return materialize(requests.groupBy("bucket").applyInArrow(answer, answered), "pitman-yor-words")


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing of whole numbers: buckets and draws that don't depend on the order of rows."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pairs(held: dict, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context numbers, dish numbers, row of the text) of every token, ends included."""
    lengths = held["lengths"]
    ends = np.cumsum(lengths + 1) - 1
    dish = np.full(len(held["tokens"]) + len(lengths), EDGE, np.int64)
    inner = np.ones(len(dish), bool)
    inner[ends] = False
    dish[inner] = number[held["tokens"]]
    context = np.r_[np.int64(EDGE), dish[:-1]] if len(dish) else dish
    return context, dish, np.repeat(np.arange(len(lengths)), lengths + 1)


def _pair_counts(chunks: DataFrame, numbers: DataFrame, buckets: int) -> DataFrame:
    """Rows of four kinds: pairs (u, w, n) that stand twice or more in training rows; packed contexts and
    dishes with the number of their pairs that stand once, by bucket of their number; and for each chunk
    (chunk, bucket, data) the counts of its pairs in the order of the pairs."""
    asked, answered = "bucket int, chunk long, data binary", "kind string, u long, w long, n long, bucket int, chunk long, data binary"

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data, answers in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                held = _unpack(data)
                number = np.zeros(len(held["words"]), np.int64)
                for a in map(_unpack, answers if answers.is_valid else ()):
                    number[a["at"]] = a["number"]
                context, dish, text = _pairs(held, number)
                known = (context > 0) & (dish > 0)
                key = ((context[known] << 32 | dish[known]).astype(np.uint64) << np.uint64(1)) | held["training"][text[known]].astype(np.uint64)
                key.sort()
                pair = (key >> np.uint64(1)).astype(np.int64)
                first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if len(pair) else np.empty(0, np.int64)
                n = np.add.reduceat((key & np.uint64(1)).astype(np.int64), first) if len(pair) else first
                pair = pair[first]
                for bucket, at in _split((_mix(pair) % np.uint64(buckets)).astype(np.int64)):
                    own = pair[at]
                    yield _rows([(bucket, chunk, _pack(u=np.diff(own >> 32, prepend=0), w=own & 0xFFFFFFFF, n=n[at]))], asked)
        give_back()

    def answer(table: pa.Table) -> pa.Table:
        held = [_unpack(data) for data in table.column("data")]
        pair, index = np.unique(np.concatenate([np.cumsum(h["u"], dtype=np.int64) << 32 | h["w"] for h in held]), return_inverse=True)
        n = np.bincount(index, weights=np.concatenate([h["n"] for h in held])).astype(np.int64)
        parts, rows, begin = [], [], 0
        for chunk, bucket, h in zip(table.column("chunk").to_pylist(), table.column("bucket").to_pylist(), held):
            rows.append(("answer", None, None, None, bucket, chunk, _pack(n=n[index[begin : begin + len(h["n"])]])))
            begin += len(h["n"])
        twice, once = n > 1, n == 1
        for kind, side in (("context", pair[once] >> 32), ("dish", pair[once] & 0xFFFFFFFF)):
            ids, count = np.unique(side, return_counts=True)
            rows += [(kind, None, None, None, bucket, None, _pack(id=ids[at], n=count[at])) for bucket, at in _split(ids % buckets)]
        parts.append(_rows(rows, answered))
        size, none = int(twice.sum()), lambda t: pa.nulls(int(twice.sum()), t)
        columns = [pa.array(["pair"] * size, pa.string()), pa.array(pair[twice] >> 32), pa.array(pair[twice] & 0xFFFFFFFF), pa.array(n[twice]), none(pa.int32()), none(pa.int64()), none(pa.binary())]
        parts.append(pa.RecordBatch.from_arrays(columns, schema=arrow_type(answered)))
        held = pair = index = n = None
        give_back()
        return pa.Table.from_batches(parts)

    answers = numbers.filter("chunk is not null").groupBy("chunk").agg(F.collect_list("data").alias("answers"))
    requests = chunks.select("chunk", "data").join(answers, "chunk", "left").select("chunk", "data", "answers").mapInArrow(ask, asked)
    return materialize(requests.groupBy("bucket").applyInArrow(answer, answered), "pitman-yor-pairs")


def _single(pairs: DataFrame, kind: str) -> DataFrame:
    """(id, once): how many pairs that stand once a context or dish has."""

    def add(table: pa.Table) -> pa.Table:
        held = [_unpack(data) for data in table.column("data")]
        ids, index = np.unique(np.concatenate([h["id"] for h in held]), return_inverse=True)
        n = np.bincount(index, weights=np.concatenate([h["n"] for h in held]))
        return pa.table({"id": pa.array(ids.astype(np.int64)), "once": pa.array(n.astype(np.int64))})

    packed = pairs.filter(F.col("kind") == kind).select("bucket", "data")
    return materialize(packed.groupBy("bucket").applyInArrow(add, "id long, once long"), f"pitman-yor-once-{kind}")


@lru_cache(8)
def _stirling(discount: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: [c, t] ways of seating c customers at t tables."""
    out = np.full((EXACT + 1, EXACT + 2), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(EXACT + 2)
    for c in range(EXACT):
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = out[c] + np.log(np.maximum(c - discount * t, 0))
        out[c + 1] = np.logaddexp(np.where(t <= c, stay, -np.inf), np.r_[-np.inf, out[c][:-1]])
    return out


def _by_size(n: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(n, kind="stable")
    sizes, first = np.unique(n[order], return_index=True)
    for size, a, b in zip(sizes.tolist(), first, np.r_[first[1:], len(n)]):
        if size <= EXACT:
            yield size, order[a:b]
        else:
            yield size, order[a:]  # all larger ones together
            return


def _seated(n: np.ndarray, weight: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of the tables of n customers, seated one by one, later in growing blocks."""
    mean, variance, i, most = np.ones(len(n)), np.zeros(len(n)), 1.0, float(n.max())
    while i < most:
        block = np.clip(n - i, 0, max(1.0, i / 16))
        q = weight / (weight + np.maximum(i - discount * mean, 1e-9))
        mean, variance, i = mean + block * q, variance + block * q * (1 - q), i + max(1.0, i / 16)
    return mean, variance


def tables(n: np.ndarray, weight: np.ndarray, discount: float, seed: np.ndarray | None) -> np.ndarray:
    """Tables of n customers of a dish where a new table weighs ``weight``: a draw that hashes ``seed``, or the mean without."""
    out = np.ones(len(n))
    log = np.log(weight)
    u = None if seed is None else (_mix(seed) >> np.uint64(11)).astype(np.float64) * 2.0**-53
    for size, at in _by_size(n):
        if size == 1:
            continue
        if size <= EXACT:
            t = np.arange(1, size + 1)
            share = _stirling(discount)[size, 1 : size + 1] + log[at, None] * t
            share = np.exp(share - share.max(axis=1, keepdims=True))
            if u is None:
                out[at] = (share @ t) / share.sum(axis=1)
            else:
                up = np.cumsum(share, axis=1)
                out[at] = 1 + (up < u[at, None] * up[:, -1:]).sum(axis=1)
        else:
            mean, variance = _seated(n[at].astype(np.float64), weight[at], discount)
            if u is not None:
                more = (_mix(_mix(seed[at])) >> np.uint64(11)).astype(np.float64) * 2.0**-53
                normal = np.sqrt(-2 * np.log(np.maximum(u[at], 1e-300))) * np.cos(2 * math.pi * more)
                mean = np.round(mean + np.sqrt(variance) * normal)
            out[at] = np.clip(mean, 1, n[at])
    return out


def _digamma(x: Column) -> Column:
    """Of numbers above 0: six steps up, then the asymptotic series."""
    y = x + 6
    steps = sum((1 / (x + i) for i in range(1, 6)), 1 / x)
    return F.log(y) - 1 / (2 * y) - 1 / (12 * y * y) + 1 / (120 * y**4) - steps


def _strength(state: DataFrame, strength: float, discount: float) -> float:
    """The strength after one step on ``state(n customers, tables)``: expected counts of its auxiliary
    draws under a Gamma(1, 1) prior. One row reaches the driver."""
    n, t = F.col("n").cast("double"), F.col("tables").cast("double")
    at = F.lit(strength / discount)
    opened = F.sum(at * (_digamma(at + t) - _digamma(at)) - 1)
    spread = F.sum(_digamma(strength + n) - _digamma(F.lit(strength + 1.0)))
    row = state.filter("tables > 1").agg(opened, spread).first()
    return max(1e-3, (1.0 + (row[0] or 0.0)) / (1.0 + max(row[1] or 0.0, 0.0)))


def _discount(once: int, twice: int) -> float:
    """From the numbers of dishes with one and with two customers."""
    return min(max(once / (once + 2 * twice), 0.05), 0.95) if once else 0.5


def _parent(n, t, state: dict):
    """The parent's probability of dishes with ``n`` customers at ``t`` tables there; 0 and 0: an unknown word."""
    return (n - state["base_discount"] * t + state["base"]) / (state["base_strength"] + state["customers"])


def _together(batches: Iterator[pa.RecordBatch], rows: int = 100_000) -> Iterator[list[np.ndarray]]:
    """Columns of several batches at once: a draw costs as much for few rows as for many."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield [c.to_numpy() for c in pa.Table.from_batches(held).columns]
            held, n = [], 0
    if n:
        yield [c.to_numpy() for c in pa.Table.from_batches(held).columns]


class Sampler:
    """Sweeps over the pairs. ``contexts`` has a row a restaurant (id, n customers, t<i> tables after sweep
    i), ``dishes`` one a dish of their parent (id, n<i> customers, s<i> tables there); ``states`` has each
    sweep's strengths and discounts. Sweep 0 is the start, with one table a dish."""

    def __init__(self, pairs: DataFrame, words: DataFrame, distinct: int):
        self.twice = pairs.filter("kind = 'pair'").select("u", "w", "n")
        self.once = {kind: _single(pairs, kind) for kind in ("context", "dish")}
        self.contexts, self.dishes, self.states = words, None, []
        self.types = distinct + 1  # and the unknown word
        self.discount = _discount(self.once["context"].agg(F.sum("once")).first()[0], self.twice.agg(F.count_if(F.col("n") == 2)).first()[0])
        self.strength, self.base_strength, self.base_discount, self.base_tables = 1.0, 1.0, None, 0
        self._state(self.twice.select("u", "w", F.lit(1).cast("long").alias("t")))

    def _opened(self, seats: DataFrame, side: str, kind: str, name: str) -> DataFrame:
        """(id, ``name``): tables by context or by dish."""
        both = self.once[kind].select("id", F.col("once").alias("t")).union(seats.select(F.col(side).alias("id"), "t"))
        return both.groupBy("id").agg(F.sum("t").alias(name))

    def _state(self, seats: DataFrame) -> None:
        """Tables of the restaurants, and the parent's own seating, after a sweep."""
        i, old = len(self.states), [self.contexts, self.dishes]
        self.contexts = materialize(self.contexts.join(self._opened(seats, "u", "context", f"t{i}"), "id"), "pitman-yor-contexts")
        if i:
            self.strength = _strength(self.contexts.select("n", F.col(f"t{i}").alias("tables")), self.strength, self.discount)
        parent = self._opened(seats, "w", "dish", f"n{i}")
        if self.dishes is None:
            parent = materialize(parent, "pitman-yor-parent")
            once, twice, self.base_tables = parent.agg(F.count_if(F.col("n0") == 1), F.count_if(F.col("n0") == 2), F.count("*")).first()
            self.base_discount = _discount(once, twice)
        else:
            parent = self.dishes.join(parent, "id")
        discount, names = self.base_discount, [f"{kind}{k}" for k in range(i + 1) for kind in "ns"]
        weight = (self.base_strength + discount * self.base_tables) / self.types
        ddl = "id long, " + ", ".join(f"{name} long" for name in names)

        def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, *held in _together(batches):
                t = tables(held[-1], np.full(len(ids), weight), discount, _mix(ids) + np.uint64(i))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (ids, *held, t.astype(np.int64))], schema=arrow_type(ddl))

        self.dishes = materialize(parent.select("id", *names[:-1]).mapInArrow(seat, ddl), "pitman-yor-dishes")
        customers, self.base_tables = self.dishes.agg(F.coalesce(F.sum(f"n{i}"), F.lit(0)), F.coalesce(F.sum(f"s{i}"), F.lit(0))).first()
        base = (self.base_strength + discount * self.base_tables) / self.types
        self.states.append({"strength": self.strength, "discount": self.discount, "base_strength": self.base_strength, "base_discount": discount, "base": base, "customers": customers})
        for table in old if i else [parent]:
            remove(table.sparkSession, table)

    def sweep(self) -> None:
        i, state = len(self.states), self.states[-1]
        strength, discount = state["strength"], state["discount"]

        def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for u, w, n, opened, customers, seated in _together(batches):
                t = tables(n, (strength + discount * opened) * _parent(customers, seated, state), discount, _mix(u << 32 | w) + np.uint64(i))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(w), pa.array(t.astype(np.int64))], schema=arrow_type("u long, w long, t long"))

        contexts = self.contexts.select(F.col("id").alias("u"), F.col(f"t{i - 1}").alias("opened"))
        dishes = self.dishes.select(F.col("id").alias("w"), F.col(f"n{i - 1}").alias("customers"), F.col(f"s{i - 1}").alias("seated"))
        rows = self.twice.join(contexts, "u").join(dishes, "w").select("u", "w", "n", "opened", "customers", "seated")
        seats = materialize(rows.mapInArrow(seat, "u long, w long, t long"), "pitman-yor-seats")
        self._state(seats)
        remove(seats.sparkSession, seats)
        release(seats.sparkSession)


def _states(numbers: DataFrame, state: DataFrame, names: list[str], buckets: int) -> DataFrame:
    """(chunk, data): numbers, counts and sampled states of the chunk's words."""

    def answer(asked: pa.Table, held: pa.Table) -> pa.Table:
        order = np.argsort(held.column("id").to_numpy())
        ids = np.r_[held.column("id").to_numpy()[order], np.int64(1 << 62)]
        values, rows = {n: np.r_[held.column(n).to_numpy()[order], np.int64(0)] for n in names}, []
        for chunk, data in zip(asked.column("chunk").to_pylist(), asked.column("data")):
            own = _unpack(data)
            at = np.searchsorted(ids, own["number"])
            at[ids[at] != own["number"]] = len(ids) - 1
            rows.append((chunk, _pack(at=own["at"], number=own["number"], count=own["count"], **{n: v[at] for n, v in values.items()})))
        return pa.Table.from_batches([_rows(rows, "chunk long, data binary")])

    asked = numbers.filter("chunk is not null").select("bucket", "chunk", "data")
    state = state.filter(F.col("id") > EDGE).withColumn("bucket", ((F.col("id") - 2) % buckets).cast("int"))
    return asked.groupBy("bucket").cogroup(state.groupBy("bucket")).applyInArrow(answer, "chunk long, data binary")


def score(docs: DataFrame, learn: Column, burn_in: int = 1, samples: int = 2, chunk: int = CHUNK) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_known, train_tokens, base_score, score (log10 probability
    under the average of ``samples`` sweeps)."""
    chunks = _chunks(docs, learn, chunk)
    tokens, train_tokens, train_docs = (int(x or 0) for x in chunks.agg(F.sum("tokens"), F.sum("train_tokens"), F.sum("train_docs")).first())
    buckets = max(8, tokens // BUCKET)
    numbers = _word_numbers(chunks, buckets)
    distinct = int(numbers.agg(F.sum("distinct")).first()[0] or 0) + (train_docs > 0)
    pairs = _pair_counts(chunks, numbers, buckets)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in map(_unpack, batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(own["number"].astype(np.int64)), pa.array(own["count"].astype(np.int64))], schema=arrow_type("id long, n long"))

    # a word's restaurant has as many customers as the word has places in training rows
    words = numbers.filter("chunk is null").select("data").mapInArrow(listed, "id long, n long")
    edges = docs.sparkSession.createDataFrame(pa.table({"id": pa.array([EDGE], pa.int64()), "n": pa.array([train_docs], pa.int64())}))
    sampler = Sampler(pairs, words.union(edges), distinct)
    for _ in range(burn_in + samples):
        sampler.sweep()
    history = sampler.states[burn_in:]
    names = [f"{kind}{i}" for i in range(burn_in, burn_in + samples + 1) for kind in "tns"]
    state = sampler.contexts.join(sampler.dishes, "id", "full").select("id", *(F.coalesce(n, F.lit(0)).alias(n) for n in names))
    edge = state.filter(F.col("id") == EDGE).first()
    edge, states = edge.asDict() if edge else {}, _states(numbers, state, names, buckets)

    asked = states.select("chunk", F.lit("state").alias("kind"), F.lit(None).cast("int").alias("bucket"), "data")
    asked = asked.union(pairs.filter("kind = 'answer'").select("chunk", "kind", "bucket", "data"))
    answers = asked.groupBy("chunk").agg(F.collect_list(F.struct("kind", "bucket", "data")).alias("answers"))
    ddl = "doc_id long, training boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, got in zip(batch.column(0), batch.column(1)):
                held = _unpack(data)
                size = len(held["words"]) + 1  # the last place is the edge's
                number, count = np.zeros(size, np.int64), np.zeros(size, np.int64)
                state = {name: np.zeros(size, np.int64) for name in names}
                counted = {}
                for a in got if got.is_valid else ():
                    own = _unpack(a["data"])
                    if a["kind"].as_py() == "answer":
                        counted[a["bucket"].as_py()] = own["n"]
                        continue
                    number[own["at"]], count[own["at"]] = own["number"], own["count"]
                    for name, values in state.items():
                        values[own["at"]] = own[name]
                number[-1], count[-1] = EDGE, train_docs
                for name, values in state.items():
                    values[-1] = edge.get(name, 0)

                # places of the chunk's words stand for them; the edge has the last place
                context, dish, text = _pairs(held, np.arange(size - 1))
                ends = np.cumsum(held["lengths"] + 1) - 1
                dish[ends] = size - 1
                context[np.r_[0, ends[:-1] + 1]] = size - 1
                known = (number[context] > 0) & (number[dish] > 0)
                pair = number[context] << 32 | number[dish]
                unique, first, index = np.unique(np.where(known, pair, 0), return_index=True, return_inverse=True)
                n, real = np.zeros(len(unique), np.int64), np.flatnonzero(unique > 0)
                for bucket, at in _split((_mix(unique[real]) % np.uint64(buckets)).astype(np.int64)):
                    n[real[at]] = counted[bucket]
                n_pair = np.where(known, n[index], 0)

                probability, many = np.zeros(len(dish)), n > 1  # one customer has one table
                u, w, customers = context[first[many]], dish[first[many]], np.where(number[context] > 0, count[context], 0)
                opened = [state[f"t{burn_in + i}"] for i in range(samples + 1)]
                parent = [_parent(state[f"n{burn_in + i}"], state[f"s{burn_in + i}"], history[i]) for i in range(samples + 1)]
                for i in range(samples):
                    # the sweep's own draw again, from the state before it, so that all dishes' tables sum to the context's
                    strength, discount = history[i]["strength"], history[i]["discount"]
                    seated = np.ones(len(unique))
                    seated[many] = tables(n[many], (strength + discount * opened[i][u]) * parent[i][w], discount, _mix(unique[many]) + np.uint64(burn_in + i + 1))
                    strength, discount = history[i + 1]["strength"], history[i + 1]["discount"]
                    new = opened[i + 1][context]
                    backed = np.where(new > 0, (strength + discount * new) / (strength + customers), 1.0)
                    own = np.where(n_pair > 0, (n_pair - discount * seated[index]) / (strength + customers), 0.0)
                    probability += (own + backed * parent[i + 1][dish]) / samples
                rows = len(held["lengths"])
                base = np.log10((count + 0.5) / (train_tokens + 0.5 * (distinct + 1)))[dish]
                model = np.log10(probability)
                columns = [
                    pa.array(held["doc_id"], pa.int64(), mask=held["nameless"] > 0),
                    pa.array(held["training"] > 0),
                    pa.array(held["lengths"] + 1, pa.int64()),
                    pa.array(np.bincount(text, weights=count[dish] > 0, minlength=rows).astype(np.int64)),
                    pa.array(np.full(rows, train_tokens, np.int64)),
                    pa.array(np.bincount(text, weights=base, minlength=rows)),
                    pa.array(np.bincount(text, weights=model, minlength=rows)),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow_type(ddl))
        give_back()

    return chunks.select("chunk", "data").join(answers, "chunk", "left").select("data", "answers").mapInArrow(finish, ddl)
