"""Byte-level BPE encoding and decoding with a two-tier lookup.

A pattern cuts a text into pre-tokens, each encoded alone.

1. A minimal perfect hash over the vocabulary indexes two arrays, the end of each entry in one string of bytes and its rank.  A batch's distinct
   pre-tokens probe it together in numpy; one whose bytes equal those of the entry at its slot is that entry's rank.
2. The others are merged: their bytes are a linked list, and a heap holds the neighbours that the vocabulary joins, by rank, then
   place.  A merge pushes at most two new neighbours, so a pre-token of n bytes costs n log n, whatever its length.

Pre-tokens are solved once and kept per worker, up to ``KEPT`` bytes.  Long texts are cut where a blank follows something else, which is always the end of a
pre-token, and worked on piece by piece.

Defined cases: null and empty text have no tokens; bytes that the vocabulary lacks are an error, as no ids stand for them; null ids decode to
null; an id outside the vocabulary decodes as U+FFFD; rows that repeat are each answered; result columns replace columns of
their name; other columns pass through.
"""

from __future__ import annotations

import base64
import struct
import sys
import types
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sentrymill.llm.common import column, map_batches, others, raw, ready
from sentrymill.llm.lines import build, probe

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that belongs to the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of pre-tokens kept per worker, characters of a text cut at a time, pre-tokens looked up together; they change no result.
KEPT, PIECE, TOGETHER = 48_000_000, 500_000, 200_000
UNKNOWN = "�".encode()


@dataclass
class Ranks:
    """A vocabulary: the bytes of each rank."""

    names: dict[int, bytes]
    pattern: str = PATTERN

    @classmethod
    def read(cls, data: bytes, pattern: str = PATTERN) -> Ranks:
        return cls({int(rank): base64.b64decode(name) for name, rank in (line.split() for line in data.splitlines() if line)}, pattern)

    def __post_init__(self):
        self.cut = regex.compile(self.pattern)
        self.before_blank = regex.compile(r"\S(?=\s)")
        self.ranks = {name: rank for rank, name in self.names.items()}
        ranks, names = list(self.names), list(self.names.values())
        self.sizes, self.bits, slot = build(*_digests(names))
        self.rank = np.zeros(len(names), np.int64)
        self.rank[slot] = ranks
        by_slot = [self.names[r] for r in self.rank.tolist()]
        self.ends = np.cumsum([0, *map(len, by_slot)])
        self.blob = b"".join(by_slot)
        self.known: dict[str, bytes] = {}
        self.held = 0

    def whole(self, words: list[bytes]) -> list[int]:
        """The rank of each word that is an entry; -1 for the others."""
        slots = probe(self.sizes, self.bits, *_digests(words))
        starts, ends, ranks = (a.tolist() for a in (self.ends[slots], self.ends[slots + 1], self.rank[slots]))
        return [rank if slot >= 0 and self.blob[a:b] == word else -1
                for word, slot, a, b, rank in zip(words, slots.tolist(), starts, ends, ranks, strict=True)]

    def merged(self, word: bytes) -> list[int]:
        """Ranks of a word that is no entry: the neighbours of least rank, of equal ones the leftmost, merge until none can."""
        size, get = len(word), self.ranks.get
        if size == 1:
            return [self.ranks[word]]
        bits = size.bit_length()  # a neighbour is one number: rank, start, end
        low = (1 << bits) - 1
        before = list(range(-1, size))
        end = list(range(1, size + 1))  # of the part that starts here, so the start of the next; 0 once it is taken in
        end.append(0)
        heap = [((rank << bits | i) << bits) + i + 2 for i in range(size - 1) if (rank := get(word[i:i + 2])) is not None]
        heapify(heap)
        while heap:
            pair = heappop(heap)
            i, to = pair >> bits & low, pair & low
            right = end[i]
            if not right or end[right] != to:
                continue  # one of the two has changed since
            end[i], end[right], before[to] = to, 0, i
            if to < size:
                follows = end[to]
                rank = get(word[i:follows])
                if rank is not None:
                    heappush(heap, ((rank << bits | i) << bits) + follows)
            left = before[i]
            if left >= 0:
                rank = get(word[left:to])
                if rank is not None:
                    heappush(heap, ((rank << bits | left) << bits) + to)
        out, i = [], 0
        while i < size:
            out.append(self.ranks[word[i:end[i]]])
            i = end[i]
        return out

    def words(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a text, some at a time."""
        at = 0
        while at < len(text):
            hit = self.before_blank.search(text, at + PIECE) if len(text) - at > PIECE else None
            end = hit.end() if hit else len(text)
            yield self.cut.findall(text, at, end)
            at = end

    def learn(self, words: set[str]) -> None:
        """Solves the words that are not known: entries by the hash, the rest by merging."""
        texts = list(words.difference(self.known))
        if self.held > KEPT:
            self.known.clear()
            self.held, texts = 0, list(words)
        names = [t.encode("utf-8", "surrogatepass") for t in texts]
        for text, name, rank in zip(texts, names, self.whole(names), strict=True):
            ids = (rank,) if rank >= 0 else self.merged(name)
            self.known[text] = struct.pack(f"<{len(ids)}I", *ids)
            self.held += 100 + len(name) + 4 * len(ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, 4 bytes a token, least byte first."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        size = 0

        def solve():
            self.learn(set().union(*(words for _, words in held)))
            for i, words in held:
                out[i].append(b"".join(map(self.known.__getitem__, words)))
            held.clear()

        for i, text in enumerate(texts):
            for words in self.words(text):
                held.append((i, words))
                size += len(words)
                if size > TOGETHER:
                    solve()
                    size = 0
        solve()
        return [b"".join(parts) for parts in out]

    def decode(self, ids: list[int]) -> bytes:
        try:
            return b"".join(map(self.names.__getitem__, ids))
        except KeyError:
            return b"".join([self.names.get(i, UNKNOWN) for i in ids])


def _digests(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w) for w in words), np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _of_worker(data: bytes, pattern: str) -> Ranks:
    """The vocabulary, made once in a Python worker, which serves many tasks."""
    kept = sys.modules.setdefault("_kept_byte_pairs", types.ModuleType("byte_pairs")).__dict__
    if kept.get("of") != (data, pattern):
        kept.update(of=(data, pattern), ranks=Ranks.read(data, pattern))
    return kept["ranks"]


def encoded(docs: DataFrame, path: str = RANKS, pattern: str = PATTERN, text_col: str = "text", packed: bool = False) -> DataFrame:
    """All rows and columns; ids, a list, or ``packed`` as 4 bytes a token, least byte first."""
    ready(docs.sparkSession)
    data = Path(path).read_bytes()  # under a megabyte, sent with the job
    names = others(docs, "ids")
    schema = T.StructType([docs.schema[c] for c in names]
                          + [T.StructField("ids", T.BinaryType() if packed else T.ArrayType(T.IntegerType()))])

    def run(batches):
        ranks = _of_worker(data, pattern)
        for batch in batches:
            parts = ranks.encode([t.decode("utf-8", "replace") for t in raw(batch.column(len(names)))])
            if packed:
                ids = pa.array(parts, pa.binary())
            else:
                ends = np.cumsum([0, *[len(p) >> 2 for p in parts]])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), "<i4")))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], [f.name for f in schema])

    return map_batches(docs.select(*[column(c) for c in names], column(text_col).cast("string").alias("_text")), run, schema)


def decoded(df: DataFrame, ids_col: str = "ids", path: str = RANKS) -> DataFrame:
    """All rows and columns; decoded, the bytes that the ids (a list, or packed) stand for.  Ids that ``encoded`` cut within a
    character are no text of their own, so the bytes are not made one."""
    ready(df.sparkSession)
    data = Path(path).read_bytes()
    names = others(df, "decoded")
    schema = T.StructType([df.schema[c] for c in names] + [T.StructField("decoded", T.BinaryType())])
    packed = df.schema[ids_col].dataType == T.BinaryType()
    ids = column(ids_col) if packed else column(ids_col).cast("array<int>")

    def run(batches):
        ranks = _of_worker(data, PATTERN)
        for batch in batches:
            found = batch.column(len(names))
            lists = [None if x is None else np.frombuffer(x, "<u4").tolist() for x in found.to_pylist()] if packed else found.to_pylist()
            texts = [None if x is None else ranks.decode(x) for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.binary())], [f.name for f in schema])

    return map_batches(df.select(*[column(c) for c in names], ids.alias("_ids")), run, schema)
