"""Encoding texts with a public byte-level BPE vocabulary (problem 7).

Two tiers. A minimal perfect hash over the vocabulary resolves every pre-token
that is one token of the vocabulary. A miss is encoded by merging its bytes: a
heap holds the possible merges by rank, a doubly linked list the parts that are
left. Work is done once per distinct pre-token of an Arrow batch; tokens never
cross from Python to the JVM other than as one list per text.

The vocabulary is a parameter (a file of base64 tokens and ranks) and is read by
the driver; executors get the finished tables (about 3 MB for 50,000 tokens,
bounded by the vocabulary) as a broadcast variable.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: how the public vocabularies cut text into pre-tokens.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Distinct pre-tokens a Python worker remembers before it starts afresh.
REMEMBERED = 400_000

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _mix(hashes: np.ndarray, displacement: np.ndarray | int) -> np.ndarray:
    """Second hash of a key under its bucket's displacement."""
    x = hashes ^ (np.asarray(displacement, dtype=np.uint64) * _GOLDEN)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class PerfectHash:
    """Minimal perfect hash: n keys to n slots, by a displacement per bucket of about four keys.

    Buckets are placed largest first; a bucket tries displacements until all its keys fall into
    free slots. Buckets of one key point straight at a slot that is left.
    """

    def __init__(self, keys: list[bytes]) -> None:
        n = max(1, len(keys))
        hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64)
        buckets = max(1, n // 4)
        self.displacement = np.zeros(buckets, dtype=np.int64)
        order = np.argsort(hashes % np.uint64(buckets), kind="stable")
        which = (hashes % np.uint64(buckets))[order].astype(np.int64)
        starts, ends = np.searchsorted(which, np.arange(buckets)), np.searchsorted(which, np.arange(buckets), "right")
        taken = np.zeros(n, dtype=bool)
        slot_of = np.full(len(keys), -1, dtype=np.int64)
        tries = np.arange(1, 65, dtype=np.uint64)
        for b in np.argsort(starts - ends, kind="stable"):
            members = order[starts[b] : ends[b]]
            if len(members) < 2:
                break
            base = np.uint64(0)
            while True:
                slots = (_mix(hashes[members][None, :], (tries + base)[:, None]) % np.uint64(n)).astype(np.int64)
                inner = np.sort(slots, axis=1)
                good = ~taken[slots].any(axis=1) & (np.diff(inner, axis=1) > 0).all(axis=1)
                if good.any():
                    k = int(good.argmax())
                    self.displacement[b] = int(tries[k] + base)
                    taken[slots[k]] = True
                    slot_of[members] = slots[k]
                    break
                base += np.uint64(len(tries))
        free = iter(np.flatnonzero(~taken))
        for b in np.flatnonzero(ends - starts == 1):
            slot = int(next(free))
            self.displacement[b] = -slot - 1
            slot_of[order[starts[b]]] = slot
        self.n = n
        self.slot_of = slot_of

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """Slot of each hash; for a key that isn't in the set any slot may come out."""
        d = self.displacement[(hashes % np.uint64(len(self.displacement))).astype(np.int64)]
        placed = (_mix(hashes, np.maximum(d, 0).astype(np.uint64)) % np.uint64(self.n)).astype(np.int64)
        return np.where(d < 0, -d - 1, placed)


class Encoder:
    """Text to token ids."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        tokens = list(ranks)
        self.hash = PerfectHash(tokens)
        self.keys: list[bytes] = [b""] * self.hash.n
        self.ids = np.zeros(self.hash.n, dtype=np.int64)
        for token, slot in zip(tokens, self.hash.slot_of, strict=True):
            self.keys[slot], self.ids[slot] = token, ranks[token]
        self.ranks = ranks
        self._known: dict[str, list[int]] = {}
        self._pattern = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_known": {}, "_pattern": None}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token that isn't a token itself: lowest-ranked merge first, leftmost of equals."""
        n = len(piece)
        end = list(range(1, n + 1))  # end of the part that starts at i
        before, alive = list(range(-1, n - 1)), [True] * n
        ranks, heap = self.ranks, []
        for i in range(n - 1):
            rank = ranks.get(piece[i : i + 2])
            if rank is not None:
                heap.append((rank, i, i + 2))
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            middle = end[i] if alive[i] else n
            if not alive[i] or middle >= n or end[middle] != stop:
                continue  # one of the two parts has changed since
            alive[middle], end[i] = False, stop
            if stop < n:
                before[stop] = i
                rank = ranks.get(piece[i : end[stop]])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, end[stop]))
            left = before[i]
            if left >= 0:
                rank = ranks.get(piece[left:stop])
                if rank is not None:
                    heapq.heappush(heap, (rank, left, stop))
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : end[i]]])
            i = end[i]
        return ids

    def _learn(self, words: list[str]) -> None:
        encoded = [w.encode() for w in words]
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in encoded), dtype=np.uint64, count=len(encoded))
        slots = self.hash.slots(hashes)
        ids = self.ids[slots].tolist()
        for word, raw, slot, i in zip(words, encoded, slots.tolist(), ids, strict=True):
            self._known[word] = [i] if self.keys[slot] == raw else self.merge(raw)

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """One list of ids per text; an empty list for an empty and for a null text."""
        if self._pattern is None:
            import regex

            self._pattern = regex.compile(PATTERN)
        cut = [self._pattern.findall(t) if t else [] for t in texts]
        if len(self._known) > REMEMBERED:
            self._known = {}
        known = self._known
        new = list(dict.fromkeys(w for words in cut for w in words if w not in known))
        if new:
            self._learn(new)
        return [[i for w in words for i in known[w]] for words in cut]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file; built on the driver."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    return Encoder({base64.b64decode(token): int(rank) for token, rank in pairs})


def _chunks(texts: pa.Array, size: int = 500) -> Iterator[list[str | None]]:
    for at in range(0, len(texts), size):
        yield texts.slice(at, size).to_pylist()


def token_ids(spark: SparkSession, text: Column, vocabulary: str | None = None) -> Column:
    """ARRAY<INT> of a text column; empty for empty and null texts, never null. Texts are encoded whole; strings of special tokens are ordinary text."""
    shared = spark.sparkContext.broadcast(encoder(vocabulary or default_vocabulary()))

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        offsets, values = [0], []
        for chunk in _chunks(texts):
            for ids in shared.value.encode(chunk):
                values.append(np.array(ids, dtype=np.int32))
                offsets.append(offsets[-1] + len(ids))
        flat = np.concatenate(values) if values else np.zeros(0, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), pa.array(flat, type=pa.int32()))

    return encode(text)


def token_counts(spark: SparkSession, text: Column, vocabulary: str | None = None) -> Column:
    """Number of tokens of a text column, 0 for empty and null texts."""
    shared = spark.sparkContext.broadcast(encoder(vocabulary or default_vocabulary()))

    @F.arrow_udf("int")
    def count(texts: pa.Array) -> pa.Array:
        return pa.array([len(ids) for chunk in _chunks(texts) for ids in shared.value.encode(chunk)], type=pa.int32())

    return count(text)


def encode_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(key, ids) of every row of ``documents``; repeated rows give repeated results, other columns don't matter."""
    return documents.select(F.col(key), token_ids(documents.sparkSession, F.col(text), vocabulary).alias("ids"))
