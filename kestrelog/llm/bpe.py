"""Operator 1: byte-level BPE encoding and decoding.

Each match of the pre-token pattern is merged on its own. Merges wait in a rank queue: one bucket of
linked-list positions per merge rank, and a hierarchy of 256-bit words over the ranks in which
find-first-set gives the lowest rank that has entries. An entry whose pair has changed since is stale
and is skipped. Every merge costs a logarithmic number of steps, so very long pre-tokens are no worse
per byte than short ones.

Nulls are encoded as empty text (no ids). Extra columns of the input are ignored, repeated rows give
repeated results, an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from kestrelog.llm.common import WHITE_SPACE, Memo, arrow_type, kept

#: Chunks, and pre-tokens, whose ids a worker keeps at hand (about 150 MB each): none of over 64 characters.
CACHE = 700_000
#: Letters and numbers of Unicode versions after 16, as hexadecimal ranges (fixed values): the encoding's library
#: has version 16, the pattern library a later one.
LATER = """
    558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB
    11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191
    191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4
    1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""


def _classes(pattern: str) -> str:
    """``pattern`` with white space, letters and numbers as sets of their own, in the pattern library's V1 syntax."""
    later = "".join("-".join(f"\\U{int(end, 16):08X}" for end in part.split("-")) for part in LATER.split())
    letter, number = rf"[[A-Za-z][\p{{L}}--[{later}]]]", rf"[[0-9][\p{{N}}--[{later}]]]"
    # the pattern's own white space class is the Unicode property, whatever a library takes \s for
    own = pattern.replace(r"[^\s", f"[^{WHITE_SPACE}").replace(r"\S", f"[^{WHITE_SPACE}]").replace(r"\s", f"[{WHITE_SPACE}]")
    return own.replace(r"\p{L}", letter).replace(r"\p{N}", number)


class RankQueue:
    """Priority queue over ranks 0..size-1; within a rank the smallest position comes first. A bit of
    ``top`` is a word of ``low``, a bit of such a word of 256 a rank that has a bucket.

    :meth:`BytePairCodec.merge` works on the fields itself, in the same steps.
    """

    def __init__(self, size: int):
        self.buckets: dict[int, list[int]] = {}
        self.low = [0] * ((size >> 8) + 1)
        self.top = 0  # an int of any width

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [position]
            self.low[rank >> 8] |= 1 << (rank & 255)
            self.top |= 1 << (rank >> 8)
        else:
            heapq.heappush(bucket, position)

    def pop(self) -> tuple[int, int]:
        """Lowest rank and its smallest position; the queue must not be empty."""
        a = (self.top & -self.top).bit_length() - 1
        word = self.low[a]
        rank = (a << 8) + (word & -word).bit_length() - 1
        bucket = self.buckets[rank]
        position = heapq.heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self.low[a] &= self.low[a] - 1
            if not self.low[a]:
                self.top &= self.top - 1
        return rank, position


class BytePairCodec:
    """Encoder and decoder for the ranks of a tiktoken file; ``pattern`` cuts a text into pre-tokens."""

    def __init__(self, path: str, pattern: str, cache: int = CACHE):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.vocabulary = {rank: token for token, rank in self.ranks.items()}
        self.queue = RankQueue(max(self.ranks.values(), default=0) + 1)
        self.bits = [1 << i for i in range(max(256, len(self.queue.low)))]
        self.two = [[self.ranks.get(bytes((a, b)), -1) for b in range(256)] for a in range(256)]
        white = f"[{WHITE_SPACE}]"
        self.split = regex.compile(_classes(pattern), regex.V1).findall
        self.uneven = re.compile(f" (?:{white}|\\Z)").search
        self.cut = re.compile(f" (?=[^{WHITE_SPACE}])").split
        self.tokens = Memo(lambda token: self.merge(token.encode()), cache)
        self.first = Memo(self._chunk, 50_000)
        self.rest = Memo(lambda part: self._chunk(" " + part), cache)

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        found = [self.tokens[token] for token in self.split(chunk)]
        return found[0] if len(found) == 1 else tuple(itertools.chain.from_iterable(found))

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one pre-token. The rank queue stands here inline: this is the inner loop."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return (whole,)
        get, n, two, bits = ranks.get, len(piece), self.two, self.bits
        buckets, low, top, heappush, heappop = self.queue.buckets, self.queue.low, 0, heapq.heappush, heapq.heappop
        drop = buckets.pop
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = [two[a][b] for a, b in zip(piece, piece[1:])]  # rank of the pair that begins here
        pair.append(-1)
        for i, rank in enumerate(pair):
            if rank in buckets:
                heappush(buckets[rank], i)
            elif rank >= 0:
                buckets[rank] = [i]
                low[word := rank >> 8] |= bits[rank & 255]
                top |= bits[word]
        while top:
            a = (top & -top).bit_length() - 1
            word = low[a]
            rank = (a << 8) + (word & -word).bit_length() - 1
            bucket = drop(rank)
            if len(bucket) > 1:
                i = heappop(bucket)
                buckets[rank] = bucket
            else:
                i = bucket[0]
                low[a] = word = word & (word - 1)
                if not word:
                    top &= top - 1
            if pair[i] != rank:
                continue  # stale: a neighbour has been merged meanwhile
            j = after[i]
            k = after[i] = after[j]
            pair[i] = pair[j] = -1
            if k < n:
                before[k] = i
                if (rank := get(piece[i : after[k]])) is not None:
                    pair[i] = rank
                    if rank in buckets:
                        heappush(buckets[rank], i)
                    else:
                        buckets[rank] = [i]
                        low[word := rank >> 8] |= bits[rank & 255]
                        top |= bits[word]
            if (h := before[i]) >= 0:
                pair[h] = rank = get(piece[h:k], -1)
                if rank in buckets:
                    heappush(buckets[rank], h)
                elif rank >= 0:
                    buckets[rank] = [h]
                    low[word := rank >> 8] |= bits[rank & 255]
                    top |= bits[word]
        ids, i = [], 0
        while i < n:
            k = after[i]
            ids.append(ranks[piece[i:k]])
            i = k
        return tuple(ids)

    def encode(self, text: str) -> list[int]:
        """A match never runs across a blank that stands before a visible character, so the text is
        cut there and the ids of a chunk are looked up before they are computed."""
        if not text:
            return []
        parts = self.cut(text) if self.uneven(text) else text.split(" ")
        if parts[0] == "" and len(parts) > 1:  # the text begins with a blank
            return list(itertools.chain.from_iterable(map(self.rest.__getitem__, parts[1:])))
        ids = list(self.first[parts[0]])
        ids.extend(itertools.chain.from_iterable(map(self.rest.__getitem__, parts[1:])))
        return ids

    def decode(self, ids) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))


def bpe_round_trip(docs: DataFrame, path: str, pattern: str, keep_ids: bool = False, cache: int = CACHE) -> DataFrame:
    """Encode every text and decode the ids again: doc_id, n_tokens, ids_sha256, decoded_sha256, and
    token_ids array<int> if ``keep_ids``. A narrow map: no shuffle, a batch of rows at a time. ``cache``
    bounds what a worker keeps at hand, which costs memory or time, and never changes a result."""
    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * keep_ids
    schema = arrow_type(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = kept("bpe", (path, pattern, cache), lambda: BytePairCodec(path, pattern, cache))
        names = {i: str(i) for i in codec.vocabulary}
        for batch in batches:
            counts, sums, backs, lists = [], [], [], []
            for text in batch.column(1):
                ids = codec.encode(text.as_py() or "")
                counts.append(len(ids))
                sums.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                backs.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                if keep_ids:
                    lists.append(pa.array(ids, pa.int32()))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(sums, pa.string()), pa.array(backs, pa.string())]
            if keep_ids:
                offsets = pa.array([0, *itertools.accumulate(counts)], pa.int32())
                columns.append(pa.ListArray.from_arrays(offsets, pa.concat_arrays(lists) if lists else pa.array([], pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, ddl)
