"""Byte-level BPE by monoid tree reduction.

A piece of text (one match of the split pattern) is encoded by halves: leaves are merged by rank,
neighbours are joined by re-encoding a window around the seam. The window grows until the tokens
on its rim are settled with the first token outside. Two neighbours are settled when their bytes,
encoded alone, give the same two tokens. A sequence in which all neighbours are settled is the
encoding of its bytes: the first merge across a seam would also happen when those two tokens are
encoded alone. So the join is exact, and the operation is associative: long pieces can be cut anywhere.

Decoding concatenates token bytes.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame

from pressroom.llm.common import attach, fresh

LEAF_BYTES = 32
CACHE_PIECES = 400_000
CACHED_CHARS = 48
NEVER = 1 << 62


def read_ranks(blob: bytes) -> dict[bytes, int]:
    """Ranks from the text of a rank file: a base64 token and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, blob.splitlines()) if token}


class Codec:
    """Encoder and decoder for one set of ranks and one split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.find = regex.compile(pattern).findall
        self._pieces: dict[str, list[int]] = {}
        self._pairs: dict[tuple[int, int], bool] = {}
        self.spelled = {rank: str(rank) for rank in self.tokens}

    def merge(self, data: bytes) -> list[int]:
        """Merge neighbours of lowest rank, leftmost first, until none can be merged."""
        ranks = self.ranks
        if len(data) > LEAF_BYTES:
            return self._merge_long(data)
        get, n = ranks.get, len(data)
        starts = list(range(n + 1))  # of the parts, and the end
        worth = [get(data[i : i + 2], NEVER) for i in range(n - 1)]  # rank of each part with its successor
        while worth:
            best = min(worth)
            if best == NEVER:
                break
            i = worth.index(best)
            del starts[i + 1], worth[i]
            if i:
                worth[i - 1] = get(data[starts[i - 1] : starts[i + 1]], NEVER)
            if i < len(worth):
                worth[i] = get(data[starts[i] : starts[i + 2]], NEVER)
        return [ranks[data[i:j]] for i, j in pairwise(starts)]

    def _merge_long(self, data: bytes) -> list[int]:
        """The same with a heap and linked neighbours, for windows that have grown."""
        ranks, n = self.ranks, len(data)
        end = list(range(1, n + 1))  # end of the part that starts here
        before = list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop or not alive[end[i]]:
                continue
            alive[end[i]] = False
            end[i] = stop
            if stop < n:
                before[stop] = i
                if (r := ranks.get(data[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (left := before[i]) >= 0 and (r := ranks.get(data[left:stop])) is not None:
                heapq.heappush(heap, (r, left, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    def settled(self, left: int, right: int) -> bool:
        key = (left, right)
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= CACHE_PIECES:
                self._pairs.clear()
            known = self._pairs[key] = self.merge(self.tokens[left] + self.tokens[right]) == [left, right]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of the concatenation of two encoded strings."""
        if not left or not right:
            return left + right
        i = j = 1
        while True:
            window = self.merge(self.decode(left[-i:]) + self.decode(right[:j]))
            left_settled = i >= len(left) or self.settled(left[-i - 1], window[0])
            right_settled = j >= len(right) or self.settled(window[-1], right[j])
            if left_settled and right_settled:
                return left[: len(left) - i] + window + right[j:]
            if not left_settled:
                i = min(2 * i, len(left))
            if not right_settled:
                j = min(2 * j, len(right))

    def reduce(self, data: bytes) -> list[int]:
        if len(data) <= LEAF_BYTES:
            return self.merge(data)
        half = len(data) // 2
        return self.join(self.reduce(data[:half]), self.reduce(data[half:]))

    def encode_piece(self, piece: str) -> list[int]:
        data = piece.encode()
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.reduce(data)

    def encode(self, text: str) -> list[int]:
        cache, out = self._pieces, []
        for piece in self.find(text):
            ids = cache.get(piece)
            if ids is None:
                ids = self.encode_piece(piece)
                if len(piece) <= CACHED_CHARS:
                    if len(cache) >= CACHE_PIECES:
                        cache.clear()
                    cache[piece] = ids
            out += ids
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_codecs: dict[tuple[int, str], Codec] = {}


def _codec(blob: bytes, pattern: str) -> Codec:
    """One codec per worker and rank file."""
    key = (hash(blob), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(read_ranks(blob), pattern)
    return _codecs[key]


OUTPUTS = {
    "n_tokens": "bigint",
    "ids": "array<int>",
    "ids_sha256": "string",
    "decoded": "binary",
    "decoded_sha256": "string",
    "round_trip": "boolean",
}


def tokenise(
    df: DataFrame,
    rank_file: str,
    pattern: str,
    keys: tuple[str, ...] = ("doc_id",),
    text: str = "text",
    outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded"),
) -> DataFrame:
    """Encode ``text`` and decode the ids again: one row per input row with ``keys`` and ``outputs``.

    outputs: ``n_tokens``, ``ids``, ``ids_sha256`` (of the decimal ids with one space between),
    ``decoded`` (bytes of the decoded ids), ``decoded_sha256``, ``round_trip`` (they are the text). NULL text is an empty text: no ids,
    zero bytes. Rows with NULL or repeated keys are kept as they are; other columns are not read.
    The rank file is read on the driver (under 2 MB) and broadcast, so executors need no file.
    """
    with open(rank_file, "rb") as file:
        blob = df.sparkSession.sparkContext.broadcast(file.read())

    def kernel(texts: pa.Array) -> dict[str, list]:
        codec = _codec(blob.value, pattern)
        out: dict[str, list] = {o: [] for o in outputs}
        for value in texts.to_pylist():
            ids = codec.encode(value or "")
            decoded = codec.decode(ids)
            for name in outputs:
                if name == "n_tokens":
                    out[name].append(len(ids))
                elif name == "ids":
                    out[name].append(ids)
                elif name == "ids_sha256":
                    out[name].append(hashlib.sha256(" ".join(map(codec.spelled.__getitem__, ids)).encode()).hexdigest())
                elif name == "decoded":
                    out[name].append(decoded)
                elif name == "decoded_sha256":
                    out[name].append(hashlib.sha256(decoded).hexdigest())
                else:
                    out[name].append(decoded == (value or "").encode())
        return out

    name = fresh(df, "result")
    fields = ", ".join(f"{o} {OUTPUTS[o]}" for o in outputs)
    return attach(df, [text], kernel, fields, name, keep=keys).select(*keys, f"{name}.*")
