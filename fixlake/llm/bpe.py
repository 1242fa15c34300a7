"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: a pre-token that is itself a token takes one probe and one byte
comparison. Tier two merges the bytes of any other pre-token on a linked list, with a heap that yields the lowest rank
first and, among equal ranks, the leftmost pair; it takes O(n log n) time for a pre-token of n bytes, and about 70 bytes of memory for each of them.

Defined cases: a null text counts as empty; an empty text has no tokens; rows are independent, so repeated rows give
repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import re
from array import array
from collections.abc import Iterable

import numpy as np
import public_tokenizers
import regex
import xxhash
from pyspark.sql import DataFrame

from fixlake.llm.common import per_row

VOCABULARY = "byte_bpe_50k.tiktoken"
#: What public_tokenizers.PATTERN matches in ASCII texts, for the standard library's faster engine.
ASCII_PATTERN = re.compile(r" ?[A-Za-z]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
#: Pre-tokens whose ids a task remembers; a full memory is emptied, which costs time only.
MEMORY = 400_000
#: Bytes of the longest pre-token that is remembered.
SHORT = 64
#: Pre-tokens taken from a text at a time, so that a very long text needs no list of all of them.
CHUNK = 65_536
#: Bits of a place in a pre-token, below the rank in the heap's entries.
_PLACE = 40
#: Bytes of a pre-token whose links are kept in arrays, which are slower and smaller than lists.
_LARGE = 1 << 16


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class PerfectHash:
    """Minimal perfect hash by displacement: keys fall into buckets, and each bucket stores the shift that sends its keys to
    free slots of their own. Buckets of one key store their slot itself, as a negative number."""

    def __init__(self, keys: list[bytes]):
        self.size = n = max(1, len(keys))
        self.buckets = n // 3 + 1
        low, high, bucket = self._split(np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64))
        self.shift = np.zeros(self.buckets, dtype=np.int64)
        order = np.argsort(bucket, kind="stable")
        counts = np.bincount(bucket.astype(np.int64), minlength=self.buckets)
        ends = np.cumsum(counts)
        taken = bytearray(n)
        self.key_at = np.full(n, -1, dtype=np.int64)
        lows, highs = low.tolist(), high.tolist()
        for b in np.argsort(-counts, kind="stable").tolist():
            members = order[ends[b] - counts[b] : ends[b]].tolist()
            if len(members) < 2:
                break
            for shift in range(1, 1 << 22):
                slots = {(lows[m] + shift * highs[m]) % n for m in members}
                if len(slots) == len(members) and not any(map(taken.__getitem__, slots)):
                    break
            else:
                raise ValueError("keys repeat")
            for m in members:
                slot = (lows[m] + shift * highs[m]) % n
                taken[slot], self.key_at[slot] = 1, m
            self.shift[b] = shift
        free = np.flatnonzero(np.frombuffer(taken, dtype=np.uint8) == 0)
        single = np.flatnonzero(counts == 1)
        for slot, b in zip(free.tolist(), single.tolist(), strict=False):
            self.shift[b] = -slot - 1
            self.key_at[slot] = order[ends[b] - 1]

    def _split(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(0x1FFFFF)
        low, high = digests & mask, ((digests >> np.uint64(21)) & mask) | np.uint64(1)
        return low, high, (digests >> np.uint64(42)) % np.uint64(self.buckets)

    def slots(self, keys: list[bytes]) -> np.ndarray:
        """The slot of each key; keys that the hash was not built from get an arbitrary one."""
        low, high, bucket = self._split(np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64))
        shift = self.shift[bucket.astype(np.int64)]
        moved = ((low + np.maximum(shift, 0).astype(np.uint64) * high) % np.uint64(self.size)).astype(np.int64)
        return np.where(shift < 0, -shift - 1, moved)


class BytePairs:
    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.default = pattern == public_tokenizers.PATTERN
        self.tokens = dict(zip(ranks.values(), ranks.keys(), strict=True))
        keys = list(ranks)
        self.hash = PerfectHash(keys)
        self.slot_key = [keys[k] if k >= 0 else b"" for k in self.hash.key_at.tolist()]
        self.slot_id = [ranks[k] if k else -1 for k in self.slot_key]
        self.known: dict[str, bytes] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"pattern": self.pattern.pattern, "known": {}}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state | {"pattern": regex.compile(state["pattern"])}

    def merged(self, piece: bytes) -> list[int]:
        """The ids of one pre-token, by merging its bytes."""
        get, n, place = self.ranks.get, len(piece), (1 << _PLACE) - 1
        hold = list if n < _LARGE else functools.partial(array, "q")
        # a part is known by its first byte; the one behind it begins where it ends, and `pair` is the rank of the two together
        size, before, pair = hold([1]) * n, hold(range(-1, n - 1)), hold(get(piece[i : i + 2], -1) for i in range(n))
        pair[-1] = -1
        heap = [rank << _PLACE | i for i, rank in enumerate(pair) if rank >= 0]
        heapq.heapify(heap)
        while heap:
            entry = heapq.heappop(heap)
            i = entry & place
            if pair[i] != entry >> _PLACE:
                continue  # one of the two has been merged meanwhile
            j = i + size[i]
            end = j + size[j]
            size[i], pair[j], pair[i] = end - i, -1, -1
            if end < n:
                before[end] = i
                rank = pair[i] = get(piece[i : end + size[end]], -1)
                if rank >= 0:
                    heapq.heappush(heap, rank << _PLACE | i)
            h = before[i]
            if h >= 0:
                rank = pair[h] = get(piece[h:end], -1)
                if rank >= 0:
                    heapq.heappush(heap, rank << _PLACE | h)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : i + size[i]]])
            i += size[i]
        return out

    def learn(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """Remember the ids of these pre-tokens, as little-endian unsigned 32-bit integers; those of more than SHORT bytes are given back instead."""
        if len(self.known) > MEMORY:
            self.known.clear()
        pieces, long = list(pieces), {}
        raw = [p.encode() for p in pieces]
        for piece, key, slot in zip(pieces, raw, self.hash.slots(raw).tolist() if raw else (), strict=True):
            ids = [self.slot_id[slot]] if self.slot_key[slot] == key else self.merged(key)
            (self.known if len(key) <= SHORT else long)[piece] = b"".join(i.to_bytes(4, "little") for i in ids)
        return long

    def encode_chunks(self, text: str) -> Iterable[bytes]:
        """The ids of a text, in pieces of little-endian unsigned 32-bit integers."""
        at, known = 0, self.known
        pattern = ASCII_PATTERN if self.default and text.isascii() else self.pattern
        while at < len(text):
            if len(text) - at <= 8 * CHUNK:
                pieces, at = pattern.findall(text, at), len(text)
            else:
                pieces = []
                for match in pattern.finditer(text, at):
                    pieces.append(match[0])
                    at = match.end()
                    if len(pieces) == CHUNK:
                        break
                else:
                    at = len(text)
            new = {p for p in pieces if p not in known}
            long = self.learn(new) if new else {}
            yield b"".join([known[p] if p in known else long[p] if p in long else self._again(p) for p in pieces])

    def _again(self, piece: str) -> bytes:
        return self.learn([piece]).get(piece) or self.known[piece]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join(self.encode_chunks(text)), dtype="<u4").tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """Number of tokens, SHA-256 of the ids, SHA-256 of what the ids decode to; a chunk at a time."""
        count, ids_sha, text_sha = 0, hashlib.sha256(), hashlib.sha256()
        for ids in self.encode_chunks(text or ""):
            count += len(ids) // 4
            ids_sha.update(ids)
            text_sha.update(self.decode(np.frombuffer(ids, dtype="<u4").tolist()))
        return count, ids_sha.hexdigest(), text_sha.hexdigest()


def encode_decode(
    df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, pattern: str = public_tokenizers.PATTERN
) -> DataFrame:
    """Encode each text and decode it again: (key, n_tokens, ids_sha256, decoded_sha256). The vocabulary, which is of
    fixed size, goes to each task by broadcast."""
    coder = df.sparkSession.sparkContext.broadcast(BytePairs(read_ranks(vocabulary or public_tokenizers.path(VOCABULARY)), pattern))
    out = per_row(
        df, [key, text], lambda k, t, coder: (k, *coder.digests(t)), f"{key} long, n_tokens long, ids_sha256 string, decoded_sha256 string",
        lambda: {"coder": coder.value},
    )
    return out


def encode_ids(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """The token ids themselves: (key, ids)."""
    coder = df.sparkSession.sparkContext.broadcast(BytePairs(read_ranks(vocabulary or public_tokenizers.path(VOCABULARY))))
    return per_row(
        df, [key, text], lambda k, t, coder: (k, coder.encode(t or "")), f"{key} long, ids array<long>", lambda: {"coder": coder.value}
    )


def decode_ids(df: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """(key, decoded): the bytes of each list of ids; null decodes to nothing."""
    coder = df.sparkSession.sparkContext.broadcast(BytePairs(read_ranks(vocabulary or public_tokenizers.path(VOCABULARY))))
    return per_row(
        df, [key, ids], lambda k, i, coder: (k, coder.decode(i or ())), f"{key} long, decoded binary", lambda: {"coder": coder.value}
    )
