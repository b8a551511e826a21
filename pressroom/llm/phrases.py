"""Collocations: phrases of two to four words that stand together more often than their parts suggest.

1. Shards. Every task turns its texts into runs of four words, one for each word, sorts and sums them, and
   builds a weighted acyclic automaton of them as it goes (``automata``), one for each language and some
   ``SHARD_RUNS`` distinct runs. The weight of a beginning is how often that phrase occurs, so one automaton
   counts the phrases of one to four words.
2. Prefix ranges. Evenly spaced runs of all shards, ranked by Spark, give the borders of ranges of about
   ``RANGE_RUNS`` runs. Shards are cut at the borders and united range by range, summing weights. A range ends
   wherever a border is, also inside the runs that begin with one frequent word, so no word or language
   makes a range larger. The few beginnings that a border divides are summed once more.
3. Look-ups. Phrases that are frequent enough make one count transducer for each range and language. The parts
   of every candidate are sent to the range that they lie in and composed with its transducer, in chunks of
   ``CHUNK`` requests, each with a copy of the transducer, so a word that is part of many candidates is shared out.
4. Scores, the rule about longer candidates, and the first phrases of each language are DataFrame work.

A part occurs at least as often as the whole, so only phrases with the least count are ever kept after step 2.
Words are cut in UTF-8; only A-Z are lower-cased.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressroom.llm.automata import DEPTH, Automaton, Windows
from pressroom.llm.common import give_back, settle, ship
from pressroom.operators.ranking import with_rank

LEAST = 30
TOP = 2000
INSIDE_PERCENT = 80
NO_LANGUAGE = "und"

UNIT_BYTES = 2 << 20
HELD_BYTES = 8 << 20
SHARD_RUNS = 1_500_000
RANGE_RUNS = 1_000_000
SAMPLES = 64  # evenly spaced runs that are looked at for every range
MOST_RANGES = 100_000  # borders are sent to every task
CHUNK = 200_000
SALTS = 64

_BORDER = b"."
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else ord(_BORDER) if chr(c) in ".,;:!?" or 10 <= c <= 13 else 32 if c == 9 else c for c in range(256)
)


def tokens(texts: list[str]) -> pa.Array:
    """Words of the texts in order, with a border after every piece. Only blanks and tabs are left to split at."""
    data = np.frombuffer("\n".join([*texts, ""]).encode().translate(_FOLD), np.uint8)
    blank, border = data == 32, data == ord(_BORDER)
    first = border.copy()  # a border is a word of its own
    first[:1] = True
    first[1:] |= blank[:-1] | border[:-1]
    said = ~blank
    ends = np.append(np.flatnonzero(first[said]), np.count_nonzero(said))
    buffers = [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data[said])]
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, buffers)


class Shard:
    """Runs of one language so far."""

    def __init__(self):
        self.texts: list[str] = []
        self.chars = 0
        self.parts: list[Windows] = []

    def add(self, text: str) -> None:
        self.texts.append(text)
        self.chars += len(text)

    def settle(self) -> None:
        if self.texts:
            self.parts.append(Windows.of(tokens(self.texts), _BORDER))
            self.texts, self.chars = [], 0

    @property
    def runs(self) -> int:
        return sum(map(len, self.parts))

    def windows(self) -> Windows:
        self.settle()
        united = Windows.union(self.parts)
        self.parts = []
        return united


def shards(documents: DataFrame, range_runs: int = RANGE_RUNS, shard_runs: int = SHARD_RUNS) -> DataFrame:
    """(lang, words, sample, blob): automata of runs, how many words they are made of, and evenly spaced runs."""
    step = max(1, range_runs // SAMPLES)
    read = documents.select(
        F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.coalesce("text", F.lit("")).alias("text")
    )
    fields = pa.schema([("lang", pa.string()), ("words", pa.int64()), ("sample", pa.list_(pa.list_(pa.string()))), ("blob", pa.binary())])

    def row(lang: str, windows: Windows) -> pa.RecordBatch:
        spaced = range(min(len(windows), step) // 2, len(windows), step)
        sample = [[word.decode() for word in windows.words(i)] for i in spaced]
        values = [lang], [int(windows.weights.sum())], [sample], [Automaton.build(windows).packed()]
        return pa.record_batch([pa.array(v, field.type) for v, field in zip(values, fields)], schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Shard] = {}
        chars = 0
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"]):
                text = text.as_py()
                shard = held.setdefault(lang, Shard())
                shard.add(text)
                chars += len(text)
                if shard.chars < UNIT_BYTES and chars < HELD_BYTES:
                    continue
                for one in [shard] if chars < HELD_BYTES else held.values():
                    chars -= one.chars
                    one.settle()
                if sum(one.runs for one in held.values()) >= shard_runs:
                    fullest = max(held, key=lambda name: held[name].runs)
                    chars -= held[fullest].chars
                    yield row(fullest, held.pop(fullest).windows())
                    give_back()
        for lang, shard in held.items():
            windows = shard.windows()
            if len(windows):
                yield row(lang, windows)
        held.clear()
        give_back()  # the worker may wait for its next task for long

    return read.mapInArrow(run, "lang string, words bigint, sample array<array<string>>, blob binary")


Border = tuple[str, tuple[bytes, ...]]


def _order(border: Border) -> tuple[bytes, tuple[bytes, ...]]:
    return border[0].encode(), border[1]


def borders(built: DataFrame) -> list[Border]:
    """Where the ranges end, in the order of language and words: every so many of the sampled runs."""
    sample = settle(built.select("lang", F.explode("sample").alias("run")), "phrase-sample")
    step = max(SAMPLES, 1 + sample.count() // MOST_RANGES)
    ranked = with_rank(sample, ["lang", "run"], "place")
    found = ranked.where(F.col("place") % step == 0).select("lang", "run").distinct().collect()
    return sorted(((row.lang, tuple(word.encode() for word in row.run)) for row in found), key=_order)


def range_of(ends: list[Border], lang: str, words: tuple[bytes, ...]) -> int:
    return bisect_right(ends, _order((lang, words)), key=_order)


def _cut(built: DataFrame, ends: Broadcast) -> DataFrame:
    """(range, lang, blob): every shard in pieces that lie in one range."""
    fields = pa.schema([("range", pa.int32()), ("lang", pa.string()), ("blob", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, blob in zip(batch["lang"].to_pylist(), batch["blob"]):
                windows = Automaton.unpacked(blob.as_py()).unfold()
                number = bisect_left(ends.value, _order((lang, ())), key=_order)
                low = 0
                own = []
                while number < len(ends.value) and ends.value[number][0] == lang:
                    own.append((number, low, low := windows.span(ends.value[number][1])[0]))
                    number += 1
                own.append((number, low, len(windows)))
                own = [(number, windows.rows(low, high)) for number, low, high in own if low < high]
                values = [number for number, _ in own], [lang] * len(own), [Automaton.build(rows).packed() for _, rows in own]
                yield pa.record_batch([pa.array(v, field.type) for v, field in zip(values, fields)], schema=fields)
                del windows, own, values
                give_back()

    return built.select("lang", "blob").mapInArrow(run, "range int, lang string, blob binary")


_COUNTS = "lang string, phrase string, size int, n bigint, range int, divided boolean"


def _heavy(windows: Windows, lang: str, number: int, ends: list[Border], least: int) -> pa.RecordBatch:
    """Phrases of a united range with at least ``least``, and those that a border of the range divides."""
    out: list[tuple] = []
    near = [ends[i][1] for i in (number - 1, number) if 0 <= i < len(ends) and ends[i][0] == lang]
    for size in range(1, DEPTH + 1):
        divided = {words[:size] for words in near if len(words) >= size} if size < DEPTH else set()
        starts, sums = windows.beginnings(size)
        places = {windows.span(words)[0]: words for words in divided}
        enough = (sums >= least) | np.isin(starts, list(places))
        for start, n in zip(starts[enough].tolist(), sums[enough].tolist()):
            words = windows.words(start, size)
            if words in divided:
                out.append((lang, b" ".join(words), size, n, range_of(ends, lang, words), True))
            elif n >= least:
                out.append((lang, b" ".join(words), size, n, number, False))
    columns = list(zip(*out)) if out else [[]] * 6
    kinds = pa.string(), pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.bool_()
    arrays = [pa.array(column, kind) for column, kind in zip(columns, kinds)]
    arrays[1] = arrays[1].cast(pa.string())
    return pa.record_batch(arrays, ["lang", "phrase", "size", "n", "range", "divided"])


def _united(pieces: DataFrame, ends: Broadcast, least: int) -> DataFrame:
    """Phrases (``_COUNTS``) of every range, from the sum of its pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple[int, str] | None = None
        parts: list[Windows] = []
        for batch in batches:
            for number, lang, blob in zip(batch["range"].to_pylist(), batch["lang"].to_pylist(), batch["blob"]):
                if (number, lang) != at:
                    if at:
                        yield _heavy(Windows.union(parts), at[1], at[0], ends.value, least)
                    at, parts = (number, lang), []
                parts.append(Automaton.unpacked(blob.as_py()).unfold())
                if sum(map(len, parts[1:])) > max(RANGE_RUNS // 4, len(parts[0])):
                    parts = [Windows.union(parts)]
        if at:
            yield _heavy(Windows.union(parts), at[1], at[0], ends.value, least)
        del parts
        give_back()

    return pieces.repartition("range").sortWithinPartitions("range", "lang").mapInArrow(run, _COUNTS)


def phrase_counts(built: DataFrame, ends: Broadcast, least: int) -> DataFrame:
    """lang, phrase, size, n, range of every phrase of one to four words that occurs ``least`` times or more."""
    found = settle(_united(_cut(built, ends), ends, least), "phrase-parts")
    divided = found.where("divided").groupBy("lang", "phrase", "size", "range").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    whole = found.where("not divided").select("lang", "phrase", "size", "n", "range")
    return settle(whole.unionByName(divided), "phrase-counts")


def _transducers(counts: DataFrame) -> DataFrame:
    """(range, lang, blob): count transducer of the frequent phrases in each range.

    The weight of a beginning is the sum of what it leads to, so a phrase goes in with its count less those of
    the phrases that go on from it within the range.
    """
    fields = pa.schema([("range", pa.int32()), ("lang", pa.string()), ("blob", pa.binary())])

    def build(rows: pa.Table) -> pa.Table:
        phrases = [tuple(phrase.encode().split(b" ")) for phrase in rows["phrase"].to_pylist()]
        whole = dict(zip(phrases, rows["n"].to_pylist()))
        own = dict(whole)
        for words, n in whole.items():
            if words[:-1] in own:
                own[words[:-1]] -= n
        symbols = sorted(set().union(*phrases))
        place = {word: i for i, word in enumerate(symbols, 1)}
        ids = sorted(([*[place[word] for word in words], *[0] * (DEPTH - len(words))], n) for words, n in own.items())
        columns = np.array([row for row, _ in ids], np.uint32).T
        windows = Windows(symbols, list(columns), np.array([n for _, n in ids], np.int64))
        values = [rows["range"][0].as_py()], [rows["lang"][0].as_py()], [Automaton.build(windows).packed()]
        return pa.table([pa.array(column, field.type) for column, field in zip(values, fields)], schema=fields)

    return counts.select("range", "lang", "phrase", "n").groupBy("range", "lang").applyInArrow(build, "range int, lang string, blob binary")


_ASKED = "range int, lang string, part string, phrase string, a bigint, k int, side int"


def _requests(candidates: DataFrame, ends: Broadcast) -> DataFrame:
    """Both parts of every cut of every candidate, each with the range that it lies in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for lang, phrase, a in zip(*(batch[name].to_pylist() for name in ("lang", "phrase", "n"))):
                words = tuple(phrase.encode().split(b" "))
                for k in range(1, len(words)):
                    for side, part in enumerate((words[:k], words[k:])):
                        out.append((range_of(ends.value, lang, part), lang, b" ".join(part).decode(), phrase, a, k, side))
            kinds = pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32()
            columns = list(zip(*out)) if out else [[]] * len(kinds)
            yield pa.record_batch([pa.array(c, kind) for c, kind in zip(columns, kinds)], ["range", "lang", "part", "phrase", "a", "k", "side"])

    return candidates.select("lang", "phrase", "n").mapInArrow(run, _ASKED)


def _composed(requests: DataFrame, transducers: DataFrame, chunk: int) -> DataFrame:
    """Requests with ``found``, the count of their part."""
    chunks = requests.groupBy("range", "lang").agg((1 + F.floor(F.count("*") / chunk)).cast("int").alias("chunks"))
    dealt = requests.join(F.broadcast(chunks), ["range", "lang"]).withColumn(
        "chunk", F.pmod(F.xxhash64("phrase", "k"), F.col("chunks")).cast("int")
    )
    copies = transducers.join(F.broadcast(chunks), ["range", "lang"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))

    def look(asked: pa.Table, held: pa.Table) -> pa.Table:
        parts = [part.encode().split(b" ") for part in asked["part"].to_pylist()]
        found = Automaton.unpacked(held["blob"][0].as_py()).compose(parts) if len(held) else np.zeros(len(parts), np.int64)
        columns = {name: asked[name] for name in ("lang", "phrase", "a", "k", "side")}
        del parts
        give_back()
        return pa.table(columns | {"found": pa.array(found, pa.int64())})

    key = ["range", "lang", "chunk"]
    left = dealt.select(*key, "part", "phrase", "a", "k", "side").groupBy(*key)
    return left.cogroup(copies.select(*key, "blob").groupBy(*key)).applyInArrow(
        look, "lang string, phrase string, a bigint, k int, side int, found bigint"
    )


def _scored(composed: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score: the cut with the lowest score, the first of equal ones."""
    part = lambda side: F.sum(F.when(F.col("side") == side, F.col("found")))
    cuts = composed.groupBy("lang", "phrase", "a", "k").agg(part(0).alias("l"), part(1).alias("r"))
    exact = F.expr("(cast(a as decimal(19,0)) * 2000000BD) div cast(l + r as decimal(20,0))")
    least = F.min(F.struct(exact.cast("bigint").alias("score"), "k", "l", "r"))
    return cuts.groupBy("lang", "phrase", "a").agg(least.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def _inside(candidates: DataFrame) -> DataFrame:
    """(lang, phrase, longer): the largest count of a candidate that has the phrase inside."""
    words = F.split("phrase", " ")
    pieces = [
        F.when((F.col("size") > size) & (F.col("size") >= start + size), F.array_join(F.slice(words, start + 1, size), " "))
        for size in range(2, DEPTH)
        for start in range(DEPTH - size + 1)
    ]
    longer = candidates.where("size > 2").select("lang", F.col("n").alias("longer"), F.explode(F.array(*pieces)).alias("phrase"))
    real = longer.where("phrase is not null")
    return real.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))


def _first(rows: DataFrame, order: list[Column], top: int) -> DataFrame:
    """The first ``top`` rows of each language with their rank: first within shares of it, so that no
    language is sorted by one task."""
    share = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    part = Window.partitionBy("lang", "share").orderBy(*order)
    best = rows.withColumn("share", share).withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top).drop("share", "rank")
    whole = Window.partitionBy("lang").orderBy(*order)
    return best.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= top)


def collocations(
    documents: DataFrame,
    least: int = LEAST,
    top: int = TOP,
    inside_percent: int = INSIDE_PERCENT,
    range_runs: int = RANGE_RUNS,
    shard_runs: int = SHARD_RUNS,
    chunk: int = CHUNK,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` best phrases of each language.

    Reads ``lang`` and ``text`` of ``documents``. n counts all words of the language, a, l and r the phrase and the
    two parts of its weakest cut, score is floor(2,000,000 a / (l + r)). Candidates occur ``least`` times; one that
    lies inside a longer candidate with at least ``inside_percent`` of its count is left out. A NULL language
    is ``und``; NULL and empty texts have no words; every row counts, repeated or not. Without candidates the
    result is empty. The last three parameters are sizes of the work and do not change the result.
    """
    spark = documents.sparkSession
    ship(spark)
    built = settle(shards(documents, range_runs, shard_runs), "phrase-shards")
    totals = built.groupBy("lang").agg(F.sum("words").alias("total"))
    ends = spark.sparkContext.broadcast(borders(built))
    counts = phrase_counts(built, ends, least)
    candidates = counts.where("size > 1")
    requests = settle(_requests(candidates, ends), "phrase-requests")
    scored = _scored(_composed(requests, _transducers(counts), chunk))
    inside = scored.join(_inside(candidates), ["lang", "phrase"], "left")
    kept = inside.where(F.coalesce(100 * F.col("longer") < inside_percent * F.col("a"), F.lit(True)))
    best = _first(kept, [F.desc("score"), F.desc("a"), F.asc("phrase")], top)
    return best.join(totals, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score"
    )
