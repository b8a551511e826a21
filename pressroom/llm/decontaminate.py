"""Benchmark decontamination with an FM-index per training shard.

A shard is a slice of rows in the partition where they are read. Its words become numbers of the
benchmark's vocabulary. A word pair that no benchmark item has cannot lie inside an occurrence, so
the text is cut there, and runs shorter than the shortest test phrase are left out: that loses
nothing and leaves little to index. The runs get a suffix array, its Burrows-Wheeler transform a
wavelet matrix with rank counts. All test phrases are searched backwards at once, their occurrences
located by walking to sampled suffix positions, and the spans merged.

The benchmark is broadcast in blocks of at most ``BLOCK_CHARS`` characters; with more than one block
the documents pass through one search after the other, and each adds its spans. No row is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressroom.llm.common import attach, fresh, run_ends

WINDOW = 13
BLOCK_CHARS = 2_000_000  # about 250 MB of Python objects while a block is built
SHARD_BYTES = 4 << 20  # of text; its words and their numbers take about six times as much
SAMPLE_EVERY = 8
FIELDS = "n_words bigint, spans array<int>, items array<string>"

# Words: runs of letters and digits of ASCII and of anything beyond it, A-Z in lower case.
_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORDS).split()


class FmIndex:
    """FM-index of a sequence of small positive numbers; 0 separates."""

    def __init__(self, text: np.ndarray, symbols: int) -> None:
        text = np.append(text, 0).astype(np.int64)
        self.n = n = len(text)
        order, rank = np.argsort(text, kind="stable"), None
        step, key = 1, text
        while True:  # prefix doubling until every suffix has its own rank
            sorted_key = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
            if rank[order[-1]] == n - 1:
                break
            following = np.zeros(n, np.int64)
            following[: n - step] = rank[step:] + 1 if step < n else 0
            key = rank * (n + 1) + following
            order = np.argsort(key, kind="stable")
            step *= 2
        self.bwt = text[order - 1]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols + 1))))
        self.sampled = (order % SAMPLE_EVERY == 0) | (self.bwt == 0)  # no step crosses a separator
        self.positions = np.where(self.sampled, order, 0)
        self.levels, row = [], self.bwt
        for bit in range(max(1, int(symbols).bit_length()) - 1, -1, -1):
            ones = (row >> bit) & 1
            counts = np.concatenate(([0], np.cumsum(ones))).astype(np.int32)
            self.levels.append((bit, counts, n - int(counts[-1])))
            row = np.concatenate((row[ones == 0], row[ones == 1]))

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol stands before ``end`` in the transform."""
        low, high = np.zeros_like(end), end
        for bit, counts, zeros in self.levels:
            one = ((symbol >> bit) & 1).astype(bool)
            low = np.where(one, zeros + counts[low], low - counts[low])
            high = np.where(one, zeros + counts[high], high - counts[high])
        return high - low

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of right-aligned phrases."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.n, np.int64)
        width = phrases.shape[1]
        for back in range(width):
            live = np.flatnonzero((lengths > back) & (low < high))
            if not len(live):
                break
            symbol = phrases[live, width - 1 - back]
            start = self.first[symbol]
            low[live] = start + self.rank(symbol, low[live])
            high[live] = start + self.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps to the left until a sampled one."""
        where, found = rows.copy(), np.zeros(len(rows), np.int64)
        steps, open_ = np.zeros(len(rows), np.int64), np.arange(len(rows))
        while len(open_):
            done = self.sampled[where[open_]]
            ended = open_[done]
            found[ended] = self.positions[where[ended]] + steps[ended]
            open_ = open_[~done]
            symbol = self.bwt[where[open_]]
            where[open_] = self.first[symbol] + self.rank(symbol, where[open_])
            steps[open_] += 1
        return found


class Phrases:
    """The test phrases of one benchmark block."""

    def __init__(self, items: list[tuple[str, str | None]], window: int) -> None:
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        pairs: set[tuple[int, int]] = set()
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            pairs.update(zip(ids, ids[1:]))
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                owners.setdefault(tuple(ids[i : i + window]), set()).add(item)
        self.base = len(self.vocabulary) + 1
        self.pairs = np.array(sorted(a * self.base + b for a, b in pairs), np.int64)
        self.lengths = np.array([len(p) for p in owners], np.int64)
        self.owners = [sorted(o) for o in owners.values()]
        width = int(self.lengths.max(initial=1))
        self.phrases = np.zeros((len(owners), width), np.int64)
        for row, phrase in enumerate(owners):
            self.phrases[row, width - len(phrase) :] = phrase

    def occurrences(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``tokens``, phrase) of every occurrence; 0 is a foreign word or a border."""
        empty = np.zeros(0, np.int64)
        if not len(self.lengths) or not len(tokens):
            return empty, empty
        linked = (tokens[:-1] > 0) & (tokens[1:] > 0)
        codes = tokens[:-1][linked] * self.base + tokens[1:][linked]
        if len(self.pairs):
            near = np.minimum(np.searchsorted(self.pairs, codes), len(self.pairs) - 1)
            linked[linked] = self.pairs[near] == codes
        else:
            linked[:] = False
        starts = np.flatnonzero((tokens > 0) & np.concatenate(([True], ~linked)))
        ends = np.flatnonzero((tokens > 0) & np.concatenate((~linked, [True]))) + 1
        keep = ends - starts >= self.lengths.min()
        starts, sizes = starts[keep], (ends - starts)[keep]
        if not len(starts):
            return empty, empty
        # each run, then a separator
        at = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
        source = np.repeat(starts - at, sizes + 1) + np.arange(int((sizes + 1).sum()))
        text = tokens[np.minimum(source, len(tokens) - 1)].copy()
        text[at + sizes] = 0
        index = FmIndex(text, self.base - 1)
        low, high = index.search(self.phrases, self.lengths)
        count = np.maximum(high - low, 0)
        phrase = np.repeat(np.arange(len(count)), count)
        rows = np.repeat(low, count) + np.arange(len(phrase)) - np.repeat(np.cumsum(count) - count, count)
        return source[index.locate(rows)], phrase


def _search(texts: list[str | None], phrases: Phrases) -> tuple[list[int], list[list[int]], list[list[str]]]:
    """Words, flattened spans and items of every text."""
    get = phrases.vocabulary.get
    tokens = [np.zeros(1, np.int64)]
    n_words = []
    for text in texts:
        found = words(text)
        n_words.append(len(found))
        tokens.append(np.fromiter((get(w, 0) for w in found), np.int64, len(found)))
        tokens.append(np.zeros(1, np.int64))
    start = np.concatenate(([0], np.cumsum(np.array(n_words) + 1)[:-1])) + 1 if texts else np.zeros(0, np.int64)
    position, phrase = phrases.occurrences(np.concatenate(tokens))
    spans: list[list[int]] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    order = np.argsort(position, kind="stable")
    position, phrase = position[order], phrase[order]
    row = np.searchsorted(start, position, side="right") - 1
    for r, p, q in zip(row.tolist(), (position - start[row]).tolist(), phrase.tolist()):
        end = p + int(phrases.lengths[q])
        mine = spans[r]
        if mine and p <= mine[-1]:
            mine[-1] = max(mine[-1], end)
        else:
            mine += (p, end)
        items[r].update(phrases.owners[q])
    return n_words, spans, [sorted(i) for i in items]


def find_spans(
    documents: DataFrame,
    benchmark: DataFrame,
    name: str,
    text: str = "text",
    window: int = WINDOW,
    keep: list[str] | None = None,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Columns ``keep`` of ``documents`` and a struct ``name``: n_words, spans, items.

    ``spans``: flattened word ranges (start, end, start, end, ...) covered by occurrences of test
    phrases, merged; ``items``: ids, as sorted text, of the items that occur. ``benchmark``: (item_id,
    text). NULL texts have no words; items without words never occur; a NULL item id is an empty
    text; repeated items count once. An empty benchmark finds nothing.
    """
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("text")
    ).distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 + chars // block_chars
    context = documents.sparkSession.sparkContext
    keep = documents.columns if keep is None else keep
    found, previous = documents, None
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()
        phrases = context.broadcast(Phrases([tuple(row) for row in rows], window))

        def kernel(texts: pa.Array, *before: pa.Array, phrases=phrases) -> dict[str, list]:
            n_words, spans, items = _search(texts.to_pylist(), phrases.value)
            for earlier in before:
                for i, old in enumerate(earlier.to_pylist()):
                    both = sorted(zip(spans[i][::2] + old["spans"][::2], spans[i][1::2] + old["spans"][1::2]))
                    spans[i] = [x for run in run_ends(*zip(*both)) for x in run] if both else []
                    items[i] = sorted({*items[i], *old["items"]})
            return {"n_words": n_words, "spans": spans, "items": items}

        last = block == blocks - 1
        target = name if last else fresh(found, f"block{block}")
        kept = keep if last else [*dict.fromkeys([*keep, text])]
        found = attach(found, [text] + ([previous] if previous else []), kernel, FIELDS, target, keep=kept, slice_bytes=SHARD_BYTES)
        previous = target
    return found


def n_hit(spans) -> F.Column:
    """Covered words of flattened spans."""
    return F.aggregate(
        F.transform(spans, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("bigint"), lambda a, x: a + x
    )


def contaminated(result: str) -> F.Column:
    """At least one hit word, and at least every twentieth word hit."""
    hit = n_hit(F.col(f"{result}.spans"))
    return (hit > 0) & (20 * hit >= F.col(f"{result}.n_words"))


def report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_spans(documents, benchmark, "result", keep=["doc_id"])
    return found.select(
        "doc_id",
        "result.n_words",
        n_hit(F.col("result.spans")).alias("n_hit"),
        F.size("result.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("result.items", ","), 256).alias("items_sha256"),
        contaminated("result").alias("contaminated"),
    )
