"""Weighted acyclic automata over short runs of words.

``Windows`` is a sorted list of distinct runs of ``DEPTH`` words (shorter ones are filled up with nothing)
with a weight each, over an alphabet of its own. ``Automaton`` is the same as an acyclic transducer from
words to weights: it is built from the sorted runs layer by layer, from the ends, and states from which the
same words lead to the same weights are one state. The weight of a beginning is the sum of all that it leads
to, so it is a property of the state that it leads to. Sums of transducers are made by unfolding and summing
sorted runs (``union``), look-ups by composing phrases, as chains of words, with a transducer (``compose``).
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

from pressroom.llm.perfect_hash import mixed

DEPTH = 4


def _sorted_sums(columns: list[np.ndarray], weights: np.ndarray | None, largest: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows in order with the sum of their weights (None: one each)."""
    bits = max(1, int(largest).bit_length())
    wide = DEPTH * bits > 64
    if wide:
        bits = 32
        keys = [columns[i].astype(np.uint64) << np.uint64(32) | columns[i + 1].astype(np.uint64) for i in range(0, DEPTH, 2)]
    else:
        key = np.zeros(len(columns[0]), np.uint64)
        for column in columns:
            key = key << np.uint64(bits) | column.astype(np.uint64)
        keys = [key]
    if wide or weights is not None:
        order = _order_of_pairs(*keys, int(largest).bit_length()) if wide else np.argsort(keys[0])
        keys = [key[order] for key in keys]
        weights = np.ones(len(order), np.int64) if weights is None else weights[order]
    else:
        keys[0].sort()
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    starts = np.flatnonzero(new)
    if weights is None:
        sums = np.diff(np.r_[starts, len(new)])
    else:
        sums = np.add.reduceat(weights, starts) if len(starts) else np.zeros(0, np.int64)
    mask, per_key = np.uint64((1 << bits) - 1), DEPTH // len(keys)
    rows = [
        (key[starts] >> np.uint64(bits * (per_key - 1 - i)) & mask).astype(np.uint32) for key in keys for i in range(per_key)
    ]
    return rows, sums


def _order_of_pairs(first: np.ndarray, second: np.ndarray, bits: int) -> np.ndarray:
    """Order by two keys, each of two columns of 32 bits of which ``bits`` are used: by the rank of the first key and the second
    in one number, where that has room for both."""
    order = np.argsort(first)
    rank = np.zeros(len(first), np.uint64)
    rank[order[1:]] = np.cumsum(first[order[1:]] != first[order[:-1]])
    if len(first).bit_length() + 2 * bits > 64:
        return np.lexsort((second, rank))
    low = np.uint64((1 << 32) - 1)
    return np.argsort(rank << np.uint64(2 * bits) | second >> np.uint64(32) << np.uint64(bits) | second & low)


def _numbered(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct words in byte order, and the place of each of ``words`` among them, counted from 0."""
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.uint32)
    place[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), place[coded.indices.to_numpy()]


@dataclass
class Windows:
    """``symbols`` are sorted; a column holds places in it, counted from 1, and 0 for nothing."""

    symbols: list[bytes]
    columns: list[np.ndarray]
    weights: np.ndarray

    def __len__(self) -> int:
        return len(self.weights)

    @staticmethod
    def of(tokens: list[bytes] | pa.Array, border: bytes) -> Windows:
        """The run that starts at each token; ``border`` is no token, and no run goes beyond one."""
        words, place = _numbered(tokens if isinstance(tokens, pa.Array) else pa.array(tokens, pa.large_binary()))
        symbols = words.to_pylist()
        none = bisect_left(symbols, border)
        ids = np.zeros(len(place) + DEPTH, np.uint32)
        ids[: len(place)] = place
        ids[: len(place)] += 1
        if none < len(symbols) and symbols[none] == border:
            del symbols[none]
            ids[: len(place)] -= place >= none
            ids[: len(place)][place == none] = 0
        at = np.flatnonzero(ids)
        columns = [ids[at]]
        for i in range(1, DEPTH):
            columns.append(np.where(columns[-1] > 0, ids[at + i], 0))
        return Windows(symbols, *_sorted_sums(columns, None, len(symbols)))

    @staticmethod
    def union(parts: Sequence[Windows]) -> Windows:
        """Equal runs become one with the sum of their weights."""
        if len(parts) == 1:
            return parts[0]
        words, place = _numbered(pa.array([word for part in parts for word in part.symbols], pa.large_binary()))
        symbols = words.to_pylist()
        ends = np.cumsum([len(part.symbols) for part in parts])
        moved = [np.r_[0, place[end - len(part.symbols) : end] + 1].astype(np.uint32) for part, end in zip(parts, ends)]
        columns = [np.concatenate([new[part.columns[i]] for new, part in zip(moved, parts)]) for i in range(DEPTH)] if parts else [np.zeros(0, np.uint32)] * DEPTH
        weights = np.concatenate([np.zeros(0, np.int64), *[part.weights for part in parts]])
        return Windows(symbols, *_sorted_sums(columns, weights, len(symbols)))

    def span(self, words: Sequence[bytes]) -> tuple[int, int]:
        """Rows that begin with ``words``; an empty span, at their place, if there are none."""
        low, high = 0, len(self)
        for column, word in zip(self.columns, words):
            at = bisect_left(self.symbols, word)
            if at == len(self.symbols) or self.symbols[at] != word:
                low += int(np.searchsorted(column[low:high], at, side="right"))
                return low, low
            found = np.searchsorted(column[low:high], [at + 1, at + 2])
            low, high = low + int(found[0]), low + int(found[1])
        return low, high

    def rows(self, low: int, high: int) -> Windows:
        """Some of the rows, over the alphabet that they use."""
        columns = [column[low:high] for column in self.columns]
        place = np.zeros(len(self.symbols) + 1, np.uint32)
        for column in columns:
            place[column] = 1
        place[0] = 0
        used = np.flatnonzero(place)
        place[used] = np.arange(1, len(used) + 1)
        return Windows([self.symbols[i - 1] for i in used.tolist()], [place[column] for column in columns], self.weights[low:high])

    def beginnings(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First row, and weight, of every distinct run of the first ``size`` words that are really there."""
        new = np.zeros(len(self), bool)
        new[:1] = True
        for column in self.columns[:size]:
            new[1:] |= column[1:] != column[:-1]
        starts = np.flatnonzero(new)
        sums = np.add.reduceat(self.weights, starts) if len(starts) else np.zeros(0, np.int64)
        real = self.columns[size - 1][starts] > 0
        return starts[real], sums[real]

    def words(self, row: int, size: int = DEPTH) -> tuple[bytes, ...]:
        return tuple(self.symbols[i - 1] for column in self.columns[:size] if (i := int(column[row])))


def _narrow(array: np.ndarray) -> np.ndarray:
    largest = int(array.max()) if len(array) else 0
    return array.astype("<u1" if largest < 1 << 8 else "<u2" if largest < 1 << 16 else "<u4" if largest < 1 << 32 else "<u8")


@dataclass
class Automaton:
    """Layer i: of its state s the arcs ``first[i][s] : first[i][s + 1]``, each a label (a place in ``symbols``,
    counted from 1, or 0) and a state of layer i + 1. States of the last layer have weights. State 0 is the start."""

    symbols: list[bytes]
    first: list[np.ndarray]
    label: list[np.ndarray]
    target: list[np.ndarray]
    weight: np.ndarray

    @staticmethod
    def build(windows: Windows) -> Automaton:
        weight, state = np.unique(windows.weights, return_inverse=True)
        at = np.arange(len(windows))  # first row of each node of the layer above the one in work
        first: list = [None] * DEPTH
        label: list = [None] * DEPTH
        target: list = [None] * DEPTH
        for layer in reversed(range(DEPTH)):
            labels = windows.columns[layer][at]
            new = np.zeros(len(at), bool)
            new[:1] = True
            for column in windows.columns[:layer]:
                new[1:] |= column[at[1:]] != column[at[:-1]]
            starts = np.flatnonzero(new)
            state, first[layer], label[layer], target[layer] = _folded(starts, labels, state)
            at = at[starts]
        return Automaton(windows.symbols, first, label, target, weight)

    def unfold(self) -> Windows:
        states = np.zeros(1 if len(self.first[0]) > 1 else 0, np.int64)
        columns: list[np.ndarray] = []
        for layer in range(DEPTH):
            begin = self.first[layer][states].astype(np.int64)
            n = self.first[layer][states + 1].astype(np.int64) - begin
            arcs = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
            columns = [np.repeat(column, n) for column in columns] + [self.label[layer][arcs].astype(np.uint32)]
            states = self.target[layer][arcs].astype(np.int64)
        return Windows(self.symbols, columns, self.weight[states].astype(np.int64))

    def totals(self) -> list[np.ndarray]:
        """Of every layer the weight of all that each state leads to."""
        sums = [self.weight.astype(np.int64)]
        for layer in reversed(range(DEPTH)):
            reached = np.r_[0, np.cumsum(sums[0][self.target[layer]])]
            sums.insert(0, np.diff(reached[self.first[layer].astype(np.int64)]))
        return sums

    def compose(self, phrases: Iterable[Sequence[bytes]]) -> np.ndarray:
        """Weight of all runs that begin with each phrase, of 1 to ``DEPTH`` words; 0 if there are none."""
        place = {word: i for i, word in enumerate(self.symbols, 1)}
        chains = [[place.get(word, -1) for word in phrase] for phrase in phrases]
        size = np.array([len(chain) for chain in chains], np.int64)
        wanted = np.full((len(chains), DEPTH), -1, np.int64)
        for i, chain in enumerate(chains):
            wanted[i, : len(chain)] = chain
        out, state = np.zeros(len(chains), np.int64), np.zeros(len(chains), np.int64)
        alive, sums, span = np.arange(len(chains)), self.totals(), len(self.symbols) + 1
        for layer in range(DEPTH):
            if not len(self.label[layer]):
                break
            source = np.repeat(np.arange(len(self.first[layer]) - 1), np.diff(self.first[layer].astype(np.int64)))
            arcs = source * span + self.label[layer]
            key = state[alive] * span + wanted[alive, layer]
            at = np.minimum(np.searchsorted(arcs, key), len(arcs) - 1)
            found = (arcs[at] == key) & (wanted[alive, layer] > 0)
            alive, at = alive[found], at[found]
            state[alive] = self.target[layer][at]
            ended = alive[size[alive] == layer + 1]
            out[ended] = sums[layer + 1][state[ended]]
            alive = alive[size[alive] > layer + 1]
        return out

    def packed(self) -> bytes:
        lengths = np.fromiter(map(len, self.symbols), np.int64, len(self.symbols))
        arrays = [lengths, self.weight, *[np.diff(first.astype(np.int64)) for first in self.first], *self.label, *self.target]
        arrays = [_narrow(array) for array in arrays]
        head = json.dumps([(array.dtype.str, len(array)) for array in arrays]).encode()
        body = b"".join([len(head).to_bytes(4, "little"), head, *[array.tobytes() for array in arrays], *self.symbols])
        return zstandard.ZstdCompressor(level=3).compress(body)

    @staticmethod
    def unpacked(data: bytes) -> Automaton:
        data = zstandard.ZstdDecompressor().decompress(data)
        at = 4 + int.from_bytes(data[:4], "little")
        arrays = []
        for kind, n in json.loads(data[4:at]):
            arrays.append(np.frombuffer(data, kind, n, at))
            at += arrays[-1].nbytes
        ends = (at + np.cumsum(arrays[0], dtype=np.int64)).tolist()
        symbols = [data[start:end] for start, end in zip([at, *ends], ends)]
        first = [np.r_[0, np.cumsum(n.astype(np.int64))] for n in arrays[2 : 2 + DEPTH]]
        return Automaton(symbols, first, arrays[2 + DEPTH : 2 + 2 * DEPTH], arrays[2 + 2 * DEPTH :], arrays[1])


def _folded(starts: np.ndarray, labels: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, ...]:
    """One state for all nodes with the same arcs: the state of each node, then the states' arcs.

    Nodes are found alike by a hash of their arcs and then compared arc by arc, so a clash of hashes
    leaves two states where one would do, and nothing else.
    """
    ends = np.r_[starts[1:], len(labels)]
    n = ends - starts
    arc = mixed(mixed(labels.astype(np.uint64)) + targets.astype(np.uint64))
    sums = np.add.reduceat(arc, starts) if len(starts) else arc
    key = mixed(sums) + n.astype(np.uint64)
    order = np.argsort(key)
    new = np.ones(len(order), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    model, state = order[new], np.empty(len(order), np.int64)
    state[order] = np.cumsum(new) - 1
    like = model[state]
    same = n[like] == n
    shift = np.repeat(starts[like] - starts, np.where(same, n, 0))
    arcs = np.flatnonzero(np.repeat(same, n))
    equal = (labels[arcs] == labels[arcs + shift]) & (targets[arcs] == targets[arcs + shift])
    same[np.searchsorted(starts, arcs[~equal], side="right") - 1] = False
    odd = np.flatnonzero(~same)
    state[odd] = len(model) + np.arange(len(odd))
    kept = np.r_[model, odd]
    size = n[kept]
    first = np.r_[0, np.cumsum(size)]
    arcs = np.repeat(starts[kept] - first[:-1], size) + np.arange(first[-1])
    return state, first, labels[arcs], targets[arcs]
