"""Ranked lexical search: the documents that answer each item best, found by scanning the texts.

There is no index of the documents. The terms of the items become one Aho-Corasick automaton, each term
guarded by a blank on both sides, and every text is read once through it (``scan``): what comes out are
the numbers of the terms that stand in the text as whole words. An output of the automaton leads to the
items that hold the term, with how often they do, so the second step (``best``) adds up scores without
looking at a text again.

The items are a stated set of queries. They are taken in blocks of about ``BLOCK_CHARS`` characters, one
automaton and one scan for each, so what the tasks are sent is bounded however many items there are. Only
counts for the block's own terms come to the driver. A task returns at most the wanted number of rows for
each item, so nothing is ever gathered for one item or one term.

Terms are the longest runs of ASCII letters, digits and characters beyond ASCII; only A-Z are lower-cased.
All scores are whole numbers.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pressroom.llm.common import attach, settle, ship

TOP = 20
BLOCK_CHARS = 2_000_000
CELLS = 2_000_000  # scores and contributions held at a time in a task

_BLANK = 32
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else _BLANK for c in range(256)
)


def folded(text: str | None) -> bytes:
    """The text with blanks for everything that is not part of a term, and one blank on either side."""
    return b" %b " % (text or "").encode().translate(_FOLD)


def terms(text: str | None) -> list[str]:
    return folded(text).decode().split()


def n_terms(flat: bytes) -> int:
    filled = np.frombuffer(flat, np.uint8) != _BLANK
    return int(np.count_nonzero(filled[1:] & ~filled[:-1]))


@functools.lru_cache(maxsize=1)
def automaton(words: tuple[str, ...]):
    """Automaton of the guarded words; its outputs are their places in ``words``."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for i, word in enumerate(words):
        found.add_word(f" {word} ", i)
    found.make_automaton()
    return found


def scan(documents: DataFrame, words: Broadcast) -> DataFrame:
    """(doc_id, n, terms, counts) of every document with a term: n counts all of its terms, the two lists
    hold those among ``words`` that it has and how often."""

    def kernel(texts: pa.Array) -> dict[str, list]:
        wanted = words.value
        out: dict[str, list] = {"n": [], "terms": [], "counts": []}
        for text in texts.to_pylist():
            flat = folded(text)
            # Two guarded words share the blank between them: matches of an automaton may overlap.
            found = Counter(map(itemgetter(1), automaton(wanted).iter(flat.decode()))) if wanted else {}
            out["n"].append(n_terms(flat))
            out["terms"].append(list(found.keys()))
            out["counts"].append(list(found.values()))
        return out

    read = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return (
        attach(read, ["text"], kernel, "n bigint, terms array<int>, counts array<int>", "s", keep=["doc_id"])
        .select("doc_id", "s.*")
        .where("n > 0")
    )


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


class Leaders:
    """The ``top`` best (score, document) of each item among all that were offered."""

    def __init__(self, items: int, top: int):
        self.items, self.top = items, top
        self.least = np.ones(items, np.int64)  # a score of zero never counts
        self.held = [np.zeros((0, 4), np.int64)]
        self.waiting = 0

    def offer(self, scores: np.ndarray, known: np.ndarray, ids: np.ndarray) -> None:
        """``scores``: one row per document, one column per item. ``known`` is 0 for a document without id."""
        row, item = np.nonzero(scores >= self.least)
        self.held.append(np.stack([item, scores[row, item], known[row], ids[row]], axis=1))
        self.waiting += len(row)
        if self.waiting > max(CELLS // 4, 4 * self.items * self.top):
            self.rows()

    def rows(self) -> np.ndarray:
        """(item, score, known, id), best first within an item; ties by id, those without one first."""
        held = np.concatenate(self.held)
        held = held[np.lexsort((held[:, 3], held[:, 2], -held[:, 1], held[:, 0]))]
        starts = np.flatnonzero(np.r_[True, held[1:, 0] != held[:-1, 0]]) if len(held) else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[starts, len(held)])
        place = np.arange(len(held)) - np.repeat(starts, sizes)
        last = place == self.top - 1
        self.least[held[last, 0]] = held[last, 1]
        held = held[place < self.top]
        self.held, self.waiting = [held], 0
        return held


def _postings(items: list[dict[int, int]], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word the items that hold it and how often: starts, items, times."""
    word = np.array([w for found in items for w in found], np.int64)
    item = np.repeat(np.arange(len(items)), [len(found) for found in items])
    times = np.array([n for found in items for n in found.values()], np.int64)
    order = np.argsort(word, kind="stable")
    return np.r_[0, np.cumsum(np.bincount(word, minlength=words))], item[order], times[order]


def best(scanned: DataFrame, items: list[dict[int, int]], weights: np.ndarray, documents: int, length: int, top: int) -> DataFrame:
    """(item, score, doc_id): of each task the best documents of each item of the block."""
    postings = _postings(items, len(weights))
    sent = scanned.sparkSession.sparkContext.broadcast((postings, weights))
    n_items = len(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (starts, item, times), weight_of = sent.value
        fan = np.diff(starts)
        leaders = Leaders(n_items, top)
        for batch in batches:
            known = np.asarray(batch["doc_id"].is_valid()).astype(np.int64)
            ids = batch["doc_id"].fill_null(0).to_numpy()
            spread = 75 + 25 * batch["n"].to_numpy() * documents // length
            at = batch["terms"].offsets.to_numpy()
            word, tf = batch["terms"].values.to_numpy(), batch["counts"].values.to_numpy().astype(np.int64)
            word, tf, at = word[at[0] : at[-1]], tf[at[0] : at[-1]], at - at[0]
            doc = np.repeat(np.arange(len(ids)), np.diff(at))
            gain = weight_of[word] * (1_000_000_000 * tf // (1000 * tf + 12 * spread[doc]))
            size = np.r_[0, np.cumsum(np.bincount(doc, weights=fan[word], minlength=len(ids)))] + n_items * np.arange(len(ids) + 1)
            first = 0
            while first < len(ids):
                # As many documents as make some two million numbers.
                last = max(first + 1, int(np.searchsorted(size, size[first] + CELLS, side="right")) - 1)
                part = slice(at[first], at[last])
                n = fan[word[part]]
                place = np.repeat(starts[word[part]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                scores = np.zeros((last - first) * n_items, np.int64)
                cell = np.repeat(doc[part] - first, n) * n_items + item[place]
                np.add.at(scores, cell, np.repeat(gain[part], n) * times[place])
                leaders.offer(scores.reshape(-1, n_items), known[first:last], ids[first:last])
                first = last
        rows = leaders.rows()
        found = pa.array(rows[:, 3], pa.int64(), mask=rows[:, 2] == 0)
        yield pa.record_batch([pa.array(rows[:, 0].astype(np.int32)), pa.array(rows[:, 1]), found], ["item", "score", "doc_id"])

    return scanned.select("doc_id", "n", "terms", "counts").mapInArrow(run, "item int, score bigint, doc_id bigint")


def _block(documents: DataFrame, rows: list, top: int) -> DataFrame | None:
    """(item_id, item, score, doc_id) for the items of one block; None without any term or document."""
    spark = documents.sparkSession
    found = [Counter(terms(row.text)) for row in rows]
    words = tuple(sorted(set().union(*found)))
    place = {word: i for i, word in enumerate(words)}
    scanned = settle(scan(documents, spark.sparkContext.broadcast(words)), "search-counts")
    total = scanned.agg(F.count("*"), F.sum("n")).first()
    if not words or not total[0]:
        return None
    holding = np.zeros(len(words), np.int64)
    for row in scanned.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
        holding[row[0]] = row[1]
    weights = np.array([weight(total[0], int(n)) for n in holding], np.int64)
    items = [{place[word]: n for word, n in one.items()} for one in found]
    ranked = best(scanned, items, weights, total[0], total[1], top)
    names = spark.createDataFrame([(i, row.item_id) for i, row in enumerate(rows)], f"item int, item_id {_type(rows)}")
    return ranked.join(F.broadcast(names), "item").select("item_id", "item", "score", "doc_id")


def _type(rows: list) -> str:
    return "string" if any(isinstance(row.item_id, str) for row in rows) else "bigint"


def search(documents: DataFrame, items: DataFrame, top: int = TOP, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The ``top`` best documents of every item: item_id, rank (int, from 1), doc_id, score.

    ``documents``: doc_id, text; ``items``: item_id, text; further columns are not read. Only scores above
    zero count, equal scores rank by ascending doc_id. Rows of ``items`` that repeat an id with another text
    are items of their own; equal rows are one. A repeated document is ranked as often as it stands there, and one
    without an id comes first among equal scores. NULL and empty texts have no terms: such an item has no
    result, and such a document does not count. Without items or documents the result is empty.
    """
    spark = documents.sparkSession
    ship(spark)
    wanted = items.select("item_id", "text").distinct().where("text is not null")
    chars = wanted.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 + chars // block_chars
    parts = []
    for number in range(blocks):
        mine = wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number)
        if part := _block(documents, mine.orderBy("item_id", "text").collect(), top):
            parts.append(part.withColumn("block", F.lit(number)))
    if not parts:
        kind = items.schema["item_id"].dataType.simpleString()
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    order = Window.partitionBy("block", "item").orderBy(F.desc("score"), F.asc("doc_id"))
    ranked = reduce(DataFrame.union, parts).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")
