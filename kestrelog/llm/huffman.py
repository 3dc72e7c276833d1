"""Operator 10: token ids as canonical length-limited Huffman shards.

Texts are encoded, an end id is appended to each, and the ids of all documents in ascending doc_id
order are cut into shards. One code, from the counts of all ids and limited in length by package-merge,
serves every shard. A shard is a file of its own in the shared folder:

    b"HTOK" | u8 version | u8 longest code | u32 ids in the vocabulary | u64 ids before this shard |
    u32 documents | u32 blocks | u32 bytes of packed lengths | lengths (zlib, one byte an id) |
    i64 doc_id of each document | u8 which have one | u32 ids of each document |
    then each block: u32 ids | u32 bytes | u32 bit offset of every STEP-th id | bits
    and, at the end, a line feed

Blocks end on bytes and are decoded on their own, by a table over the longest code; the offsets let all
runs of STEP ids in a block advance side by side. Numbers are little-endian, codes big-endian.

Spark writes the files (bytes as lines of text, one a file, under its commit protocol) and reads them as
binaryFile, so any file system that it knows will do; the ids before a shard, in its head, give the order.

Null texts count as empty: just the end id. An empty table gives no shard and no row. Repeated rows are
written as often as they stand; a null doc_id comes first. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
import os
import re
import string
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelog.llm.common import arrow_type, kept, materialize, remove, scratch_path

#: Ids in a shard (about), in a block, and between checkpoints.
SHARD, BLOCK, STEP = 1 << 20, 1 << 15, 128
#: ASCII signs: what is neither letter, digit nor white space.
SIGNS = string.punctuation.encode()
_HEAD = struct.Struct("<4sBBIQIII")


def code_lengths(counts: np.ndarray, limit: int = 16) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for the ids that occur (package-merge); else 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n <= 2:
        out[used] = 1
        return out
    if n > 1 << limit:
        raise ValueError(f"{n} ids have no codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    levels, merged = [], leaves
    flags = np.ones(n, bool)
    levels.append(flags)
    for _ in range(limit - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both, is_leaf = np.concatenate([leaves, pairs]), np.r_[np.ones(n, bool), np.zeros(len(pairs), bool)]
        by = np.argsort(both, kind="stable")
        merged, flags = both[by], is_leaf[by]
        levels.append(flags)
    take, lengths = 2 * n - 2, np.zeros(n, np.int64)
    for flags in reversed(levels):
        chosen = int(flags[:take].sum())
        lengths[:chosen] += 1
        take = 2 * (take - chosen)
    out[order] = lengths
    return out


class Code:
    """Canonical code: by length, then by id."""

    def __init__(self, lengths: np.ndarray):
        self.lengths, self.limit = lengths.astype(np.uint8), int(lengths.max(initial=1))
        ids = np.flatnonzero(lengths)
        ids = ids[np.argsort(lengths[ids], kind="stable")]
        sizes = lengths[ids].astype(np.int64)
        width = np.left_shift(1, self.limit - sizes)
        begin = np.cumsum(width) - width
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[ids] = (begin >> (self.limit - sizes)).astype(np.uint64)
        self.symbols, self.steps = np.repeat(ids, width).astype(np.uint32), np.repeat(sizes, width).astype(np.int64)
        spare = (1 << self.limit) - len(self.symbols)  # an incomplete code, as with one id
        self.symbols, self.steps = np.append(self.symbols, np.zeros(spare, np.uint32)), np.append(self.steps, np.ones(spare, np.int64))

    def pack(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bits of one block, and the bit offset of every STEP-th id."""
        size = self.lengths[ids].astype(np.int64)
        end = np.cumsum(size)
        at = end - size
        word, shift = at >> 5, (64 - (at & 31) - size).astype(np.uint64)
        value = self.codes[ids] << shift  # codes have at most 32 bits, so two 32-bit words hold one
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        out = np.zeros(int(end[-1] >> 5) + 2, np.uint64)
        out[word[first]] += np.add.reduceat(value >> np.uint64(32), first)
        out[word[first] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
        return out.astype(">u4").tobytes()[: int(end[-1] + 7) // 8], at[::STEP].astype(np.uint32)

    def unpack(self, data: bytes, n: int, offsets: np.ndarray) -> np.ndarray:
        raw = np.frombuffer(data + b"\0" * 8, np.uint8).astype(np.uint32)
        windows = (raw[:-3] << np.uint32(24)) | (raw[1:-2] << np.uint32(16)) | (raw[2:-1] << np.uint32(8)) | raw[3:]
        out = np.empty((STEP, len(offsets)), np.uint32)
        at, last, cut = offsets.astype(np.int64), 8 * len(data), np.uint32(32 - self.limit)
        for i in range(min(STEP, n)):
            at = np.minimum(at, last)  # the last run may be short
            index = (windows[at >> 3] << (at & 7).astype(np.uint32)) >> cut
            out[i] = self.symbols[index]
            at = at + self.steps[index]
        return out.T.reshape(-1)[:n] if n >= STEP else out.T[0, :n]


def write_shard(start: int, doc_ids: list, counts: np.ndarray, ids: np.ndarray, lengths: np.ndarray, code: Code | None = None) -> bytes:
    code = code or Code(lengths)
    packed = zlib.compress(lengths.astype(np.uint8).tobytes(), 6)
    blocks = range(0, len(ids), BLOCK)
    parts = [_HEAD.pack(b"HTOK", 1, code.limit, len(lengths), start, len(doc_ids), len(blocks), len(packed)), packed]
    parts += [np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is not None for d in doc_ids], np.uint8).tobytes(), counts.astype("<u4").tobytes()]
    for at in blocks:
        block = ids[at : at + BLOCK]
        bits, offsets = code.pack(block)
        parts += [struct.pack("<II", len(block), len(bits)), offsets.astype("<u4").tobytes(), bits]
    return b"".join(parts)


def read_shard(image: bytes, codes: dict) -> tuple[int, list, np.ndarray, np.ndarray]:
    """(ids before the shard, doc_ids, ids of each document, all ids); ``codes`` keeps built tables."""
    magic, version, _, size, start, n_docs, n_blocks, n_packed = _HEAD.unpack_from(image)
    if (magic, version) != (b"HTOK", 1):
        raise ValueError("not a token shard")
    at = _HEAD.size
    packed = image[at : at + n_packed]
    if packed not in codes:
        codes.clear()
        codes[packed] = Code(np.frombuffer(zlib.decompress(packed), np.uint8, size))
    code, at = codes[packed], at + n_packed
    doc_ids = np.frombuffer(image, "<i8", n_docs, at).tolist()
    has = np.frombuffer(image, np.uint8, n_docs, at + 8 * n_docs).tolist()
    counts = np.frombuffer(image, "<u4", n_docs, at + 9 * n_docs)
    at += 13 * n_docs
    parts = [np.empty(0, np.uint32)]
    for _ in range(n_blocks):
        n, size = struct.unpack_from("<II", image, at)
        steps = -(-n // STEP)
        offsets = np.frombuffer(image, "<u4", steps, at + 8)
        at += 8 + 4 * steps
        parts.append(code.unpack(image[at : at + size], n, offsets))
        at += size
    return start, [d if h else None for d, h in zip(doc_ids, has)], counts, np.concatenate(parts)


def _letters(run: bytes) -> bool:
    """All letters, in lower case too: some capitals become a letter and a mark."""
    return run.isalpha() or not run.isascii() and run.decode().lower().isalpha()


def _composed(text: str) -> bool:
    return text.isascii() or unicodedata.is_normalized("NFC", text)


#: Bytes of a run up to which its ids are kept at hand.
LONGEST = 64


class Tokens:
    """Ids of whole texts by the tokenizers library, as little-endian bytes of ``kind``. The tokenizer
    drops white space and never looks across it, so runs without ASCII white space are encoded once and
    then looked up."""

    def __init__(self, path: str, limit: int = 1_500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        size = max(vocabulary.values()) + 1
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(size, bool)
        if suffix:
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        added = sorted({str(t).encode() for t in self.tokenizer.get_added_tokens_decoder().values()} - {b""}, key=len, reverse=True)
        self.added = re.compile(b"|".join(map(re.escape, added)), re.I) if added else None
        self.known: dict[bytes, bytes] = {}
        self.limit = limit
        self.bare = Tokenizer.from_file(path)  # for lower-case ASCII words: white space is all it looks at
        self.bare.normalizer, self.bare.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        probe = f"{string.ascii_lowercase} the quick brown fox {string.ascii_lowercase[::-1]} jumps"
        if self._ids([probe]) != self._ids([probe], self.bare):
            self.bare = self.tokenizer

    def _ids(self, texts: list[str], tokenizer=None) -> list[bytes]:
        found = (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.kind).tobytes() for e in found]

    def _learn(self, runs: list[bytes]) -> None:
        """Plain words go to the tokenizer many at a time; a word's last id has the end-of-word suffix."""
        words: dict[bool, list[bytes]] = {True: [], False: []}  # by whether they are ASCII
        other, suffixed = set(), bool(self.ends.any())
        for run in runs:
            if suffixed and _letters(run):
                words[run.isascii()].append(run)
            else:
                other.add(run)
        for part, tokenizer in ((words[k][at : at + 100], t) for k, t in ((True, self.bare), (False, self.tokenizer)) for at in range(0, len(words[k]), 100)):
            data = self._ids([b" ".join(part).decode()], tokenizer)[0]
            cuts = (np.flatnonzero(self.ends[np.frombuffer(data, self.kind)]) + 1) * self.kind.itemsize
            if len(cuts) != len(part):
                other.update(part)
                continue
            low = 0
            for run, high in zip(part, cuts.tolist()):
                self.known[run] = data[low:high]
                low = high
        other = list(other)
        self.known.update(zip(other, self._ids([run.decode() for run in other])))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text. The tokenizer folds case and ends a word before a sign, so a run is
        looked up in lower case, and learned as word and signs if it is a word with signs after it. Added
        tokens match, and marks are composed, before case is folded: a text that holds an added token's
        letters in any case, or that NFC changes before or after folding, is encoded whole."""
        known = self.known
        data = [(t or "").encode() for t in texts]
        low = [t.lower() for t in data]  # bytes know ASCII only
        special = [i for i, t in enumerate(data) if self.added and self.added.search(t) or not (t.isascii() or _composed(texts[i]) and _composed(low[i].decode()))]
        whole = dict(zip(special, self._ids([texts[i] for i in special]))) if special else {}
        runs = [[] if i in whole else t.split() for i, t in enumerate(low)]
        found = [list(map(known.get, part)) for part in runs]
        gaps = [[i for i, ids in enumerate(part) if ids is None] for part in found]
        missing = {part[i] for part, at in zip(runs, gaps) for i in at}
        if missing:
            if len(known) > self.limit:
                known.clear()
            cut = {run: (word, run[len(word) :]) for run in missing if (word := run.rstrip(SIGNS)) != run and _letters(word)}
            self._learn(list((missing - cut.keys()).union(*cut.values()).difference(known)))
            for run, (word, signs) in cut.items():
                known[run] = known[word] + known[signs]
            for part, ids, at in zip(runs, found, gaps):
                for i in at:
                    ids[i] = known[part[i]]
            for run in [run for run in itertools.chain(missing, *cut.values()) if len(run) > LONGEST]:
                known.pop(run, None)  # bytes are bounded as well as entries
        return [whole[i] if i in whole else b"".join(ids) for i, ids in enumerate(found)]


def write_ids(docs: DataFrame, tokenizer_path: str, end_id: int, limit: int = 16, name: str = "shards") -> str:
    """Encode all texts and write the shards to a fresh folder under the shared one; its path. In order of
    the ids before them the files hold all documents in ascending doc_id order."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    raw_ddl = "part int, before long, first long, ids_n long, docs binary, has binary, counts binary, ids binary"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, before, schema = kept("tokens", tokenizer_path, lambda: Tokens(tokenizer_path)), 0, arrow_type(raw_ddl)
        part, width = TaskContext.get().partitionId(), tokens.kind.itemsize
        end = np.array(end_id, tokens.kind).tobytes()
        doc_ids: list = []
        counts: list[int] = []
        held: list[bytes] = []

        def shard():
            ids = b"".join(held)
            row = [part, before, doc_ids[0], len(ids) // width, np.array([d or 0 for d in doc_ids], "<i8").tobytes(), bytes(d is not None for d in doc_ids), np.array(counts, "<u4").tobytes(), ids]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, schema.types)], schema=schema)

        size = 0
        for batch in batches:
            rows = batch.column(0).to_pylist()
            for low in range(0, len(rows), 500):
                texts = batch.column(1).slice(low, 500).to_pylist()
                for doc_id, ids in zip(rows[low : low + 500], tokens.encode(texts)):
                    doc_ids.append(doc_id)
                    counts.append(len(ids) // width + 1)
                    held += (ids, end)
                    size += counts[-1]
                    if size >= SHARD:
                        yield shard()
                        before += size
                        doc_ids, counts, held, size = [], [], [], 0
        if doc_ids:
            yield shard()

    ordered = docs.selectExpr("cast(doc_id as long) doc_id", "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    raw = materialize(ordered.mapInArrow(encode, raw_ddl), "ids")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for blob, n in zip(batch.column(0), batch.column(1).to_pylist()):
                found = np.bincount(np.frombuffer(blob.as_buffer(), _kind(blob, n)), minlength=len(total))
                found[: len(total)] += total
                total = found
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    rows = raw.select("ids", "ids_n").mapInArrow(tally, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r.id for r in rows), default=0) + 1, np.int64)
    for r in rows:  # the vocabulary at most
        counts[r.id] = r.n
    base, total = {}, 0
    for r in raw.groupBy("part").agg(F.min("first").alias("first"), F.sum("ids_n").alias("n")).orderBy(F.asc_nulls_first("first"), "part").collect():
        base[r.part] = total  # one entry a partition
        total += r.n
    shared = spark.sparkContext.broadcast((code_lengths(counts, limit), base))
    ddl = "image binary"

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, base = shared.value
        code = Code(lengths)
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], _kind(r["ids"], r["ids_n"]))
                docs = [d if h else None for d, h in zip(np.frombuffer(r["docs"], "<i8").tolist(), r["has"])]
                start = base[r["part"]] + r["before"]
                image = write_shard(start, docs, np.frombuffer(r["counts"], "<u4"), ids, lengths, code)
                yield pa.RecordBatch.from_pydict({"image": [image]}, schema=arrow_type(ddl))

    path = scratch_path(spark, name)
    images = raw.mapInArrow(compress, ddl).select(F.col("image").cast("string").alias("value"))  # the same bytes
    images.write.option("maxRecordsPerFile", 1).option("lineSep", "\n").option("compression", "none").text(path)
    remove(spark, raw)
    return path


def _kind(blob, n: int):
    size = len(blob.as_buffer()) if isinstance(blob, pa.Scalar) else len(blob)
    return np.uint16 if size == 2 * n else np.uint32


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read back from the shard files of a folder."""
    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict = {}
        for batch in batches:
            for image in batch.column(0):
                start, doc_ids, counts, ids = read_shard(image.as_py(), codes)
                ends = np.cumsum(counts.astype(np.int64))
                raw = memoryview(ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist())]
                columns = [pa.array(doc_ids, pa.int64()), pa.array(start + ends - counts), pa.array(counts.astype(np.int64)), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow_type(ddl))

    files = spark.read.format("binaryFile").load(path).filter("length > 0")  # an empty table leaves an empty file
    return files.select("content").mapInArrow(run, ddl)
