"""MinHash near-duplicates with odd sketches.

1. Every document becomes the set of its word shingles (64-bit hashes), a digest of the set, MinHash
   bands, and an odd sketch: each of the MinHash samples flips one bit of a bitmap, so the number of
   ones in the XOR of two bitmaps estimates how many samples differ. One pass, no shuffle of texts.
2. Documents with equal sets are one class; only its smallest document goes on.
3. Classes that share a band are candidates. First each class is compared with the smallest class of
   its band only (a star, linear in the rows). Linked ones are put into components.
4. Then, inside a band, classes of *different* components are compared, in blocks of bounded size: the
   sketches first, the nearest first, and what passes on the full sets, inside the task. As soon as two
   components are linked, their other pairs cannot change the result and are skipped. A pair is only
   looked at in the first band that it shares. A task returns at most one link for each of its rows, so
   a group of near copies costs no quadratic output.
5. A candidate passes the sketch if the estimate is not below the threshold by more than the bitmap's
   noise; every link is confirmed on the full sets.

Two sets with a similarity of 0.8 share no band with a chance below one in a million (``BANDS``, ``ROWS``);
the sketch margin is more than five standard deviations.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressroom.llm.common import attach, connected_components, flagged, fresh, settle, ship

BANDS, ROWS = 20, 3
SAMPLES = 256
SKETCH_BITS = 2048
BLOCK = 1024

_MIX = np.uint64(0x9E3779B97F4A7C15)
_THREE = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; a shorter text is one run; none without words.

    A-Z are lower-cased; words are runs of anything but ASCII white space.
    """
    import xxhash

    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    size = min(size, len(found))
    runs = np.full(len(found) - size + 1, size, np.uint64)
    for i in range(size):
        runs = _mixed(runs * _THREE[i % 3] + hashes[i : len(hashes) - size + 1 + i])
    return np.unique(runs)


def _seeds(samples: int) -> tuple[np.ndarray, np.ndarray]:
    numbers = _mixed(np.arange(1, 2 * samples + 1, dtype=np.uint64) * _MIX)
    return (numbers[:samples] | np.uint64(1)).astype(np.uint32), (numbers[samples:] >> np.uint64(32)).astype(np.uint32)


def minhash(hashes: np.ndarray, samples: int) -> np.ndarray:
    """MinHash samples of a set of hashes."""
    a, b = _seeds(samples)
    low = hashes.astype(np.uint32)
    out = np.full(samples, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(low), 2048):  # 1 MB at a time
        part = low[start : start + 2048]
        x = part[None, :] * a[:, None] + b[:, None]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        np.minimum(out, x.min(axis=1), out=out)
    return out


def odd_sketch(samples: np.ndarray, bits: int) -> np.ndarray:
    """Parity bitmap of (place, value) of all samples."""
    spots = _mixed(samples.astype(np.uint64) + np.arange(len(samples), dtype=np.uint64) * _MIX) % np.uint64(bits)
    return np.packbits(np.bincount(spots.astype(np.int64), minlength=bits) & 1)


def most_odd_bits(similarity: float, samples: int, bits: int, deviations: float = 5.5) -> int:
    """Most ones that the XOR of two sketches has if their similarity is at least ``similarity``.

    The number of differing samples is binomial; each of them flips two bits, so the ones follow from
    m random flips: bits/2 * (1 - (1 - 2/bits)**m), with less than m of variance.
    """
    differing = samples * (1 - similarity)
    differing += deviations * math.sqrt(samples * similarity * (1 - similarity))
    flips = 2 * min(differing, samples)
    return math.ceil(bits / 2 * (1 - (1 - 2 / bits) ** flips) + 2 * math.sqrt(flips))


def features(
    documents: DataFrame, size: int, bands: int = BANDS, rows: int = ROWS, samples: int = SAMPLES, bits: int = SKETCH_BITS
) -> DataFrame:
    """Per row: doc_id, n_shingles, digest, bands (one 64-bit key each, of the first samples), sketch."""

    def kernel(texts: pa.Array) -> dict[str, list]:
        out: dict[str, list] = {"n_shingles": [], "digest": [], "bands": [], "sketch": []}
        for text in texts.to_pylist():
            found = shingles(text, size)
            out["n_shingles"].append(len(found))
            if not len(found):
                for name in ("digest", "bands", "sketch"):
                    out[name].append(None)
                continue
            values = minhash(found, samples)
            banded = values[: bands * rows].reshape(bands, rows)
            keys = np.arange(bands, dtype=np.uint64)
            for row in range(rows):
                keys = _mixed(keys * _MIX + banded[:, row])
            out["digest"].append(_digest(found))
            out["bands"].append(keys.view(np.int64).tolist())
            out["sketch"].append(odd_sketch(values, bits).tobytes())
        return out

    fields = "n_shingles bigint, digest binary, bands array<bigint>, sketch binary"
    return attach(documents, ["text"], kernel, fields, "f", keep=["doc_id"]).select("doc_id", "f.*")


def _sets(documents: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """(digest, set) of the classes, each from its document ``id``. No text is shuffled: documents that
    may be among the ids, by a bitmap, are read again where they stand, and what is not asked for is left out
    by its digest."""
    ids = classes.select("id").distinct()
    texts = flagged(documents.select("doc_id", "text"), ids, "doc_id").where("flag").select("text")

    def kernel(found: pa.Array) -> dict[str, list]:
        sets = [shingles(text, size) for text in found.to_pylist()]
        ends = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
        values = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
        return {"digest": [_digest(one) for one in sets], "set": pa.ListArray.from_arrays(ends, pa.array(values))}

    sets = attach(texts, ["text"], kernel, "digest binary, set array<bigint>", "s", keep=[]).select("s.*")
    return sets.join(classes.select("digest").distinct(), "digest", "left_semi").dropDuplicates(["digest"])


def _digest(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    held = pairs.join(sets.select(F.col("digest").alias("a"), F.col("set").alias("set_a")), "a").join(
        sets.select(F.col("digest").alias("b"), F.col("set").alias("set_b")), "b"
    )

    # In the JVM, row by row: an Arrow batch of long sets would fill the memory of a task.
    both = F.size(F.array_intersect("set_a", "set_b"))
    either = F.size("set_a") + F.size("set_b") - both
    return held.where(100 * both >= percent * either).select("a", "b")


def _ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=-1, dtype=np.int32)


def _star_pairs(stars: DataFrame, limit: int) -> DataFrame:
    """Pairs (a, b) whose sketches (sketch_a, sketch_b) differ in at most ``limit`` bits."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x, y = (np.frombuffer(b"".join(batch[c]), np.uint64).reshape(len(batch), -1) for c in ("sketch_a", "sketch_b"))
                yield batch.loc[_ones(x ^ y) <= limit, ["a", "b"]]

    return stars.mapInPandas(check, "a binary, b binary")


_PART = ["band", "low", "high"]


def _dealt(members: DataFrame, block: int) -> DataFrame:
    """``members`` (band, digest, component, n, bands, sketch) in groups band, low, high. A band of up to ``block``
    rows is one group. A larger one is dealt into parts by a hash, and each pair of parts is a group of its
    own, so no task holds more than two parts."""
    width = F.ceil(F.col("n") / block).cast("int")
    dealt = members.withColumn("width", width).withColumn("home", F.pmod(F.xxhash64("digest"), F.col("width")).cast("int"))
    return dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("width") - 1))).select(
        "band", F.least("home", "other").alias("low"), F.greatest("home", "other").alias("high"),
        "home", "digest", "component", "bands", "sketch",
    )


def _across(members: DataFrame, sets: DataFrame, percent: int, limit: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between components inside a band: enough of them to join what belongs together.

    Groups are gone through twice. First the sketches alone tell which rows have a partner that may be
    linked to them; only these, mostly a few, then meet again with their full sets.
    """
    dealt = _dealt(members, block)

    def sketched(key: tuple, rows: pa.Table) -> pa.Table:
        found = _Group(key[0].as_py(), rows).partnered(key[1].as_py(), key[2].as_py(), limit)
        return rows.select([*_PART, "home", "digest", "component", "bands", "sketch"]).take(pa.array(found))

    kinds = "band bigint, low int, high int, home int, digest binary, component binary, bands array<bigint>, sketch binary"
    open_rows = settle(dealt.groupBy(*_PART).applyInArrow(sketched, kinds), "minhash-open").join(sets, "digest")

    def compared(key: tuple, rows: pa.Table) -> pa.Table:
        a, b = _Group(key[0].as_py(), rows).linked(key[1].as_py(), key[2].as_py(), percent, limit)
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    columns = open_rows.select(*_PART, "home", "digest", "component", "bands", "sketch", "set")
    return columns.groupBy(*_PART).applyInArrow(compared, "a binary, b binary")


class _Group:
    """The rows of one group of a band."""

    def __init__(self, band: int, rows: pa.Table):
        self.rows = rows
        self.home = rows["home"].to_numpy()
        self.digests = rows["digest"].to_pylist()
        numbers: dict[bytes, int] = {}
        self.group = np.array([numbers.setdefault(c, len(numbers)) for c in rows["component"].to_pylist()], np.int64)
        self.sketch = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint64).reshape(len(self.digests), -1)
        bands = np.array(rows["bands"].to_pylist(), np.int64)
        self.earlier = bands[:, : int(np.flatnonzero(bands[0] == band)[0])]

    def candidates(self, low: int, high: int, limit: int) -> Iterator[tuple[int, np.ndarray]]:
        """Each row of part ``low``, and those of part ``high`` in another component whose sketch is near enough,
        the nearest first. A pair that shares an earlier band was looked at there."""
        right = np.flatnonzero(self.home == high)
        for i in np.flatnonzero(self.home == low).tolist():
            others = right[(self.group[right] != self.group[i]) & ((right > i) | (low != high))]
            if len(others):
                odd = _ones(self.sketch[others] ^ self.sketch[i])
                near = np.flatnonzero(odd <= limit)
                near = near[~(self.earlier[others[near]] == self.earlier[i]).any(axis=1)]
                yield i, others[near[np.argsort(odd[near], kind="stable")]]

    def partnered(self, low: int, high: int, limit: int) -> np.ndarray:
        """Places of the rows with a candidate."""
        found = np.zeros(len(self.digests), bool)
        for i, others in self.candidates(low, high, limit):
            found[others] = True
            found[i] |= len(others) > 0
        return np.flatnonzero(found)

    def linked(self, low: int, high: int, percent: int, limit: int) -> tuple[list[bytes], list[bytes]]:
        """Links found on the full sets. What a link has joined is one component from then on."""
        out_a: list[bytes] = []
        out_b: list[bytes] = []
        packed, sets, group = self.rows["set"], {}, self.group

        def shingle_set(i: int) -> frozenset:
            if i not in sets:
                sets[i] = frozenset(packed[i].as_py())
            return sets[i]

        for i, others in self.candidates(low, high, limit):
            for j in others.tolist():
                if group[i] == group[j]:
                    continue
                x, y = shingle_set(i), shingle_set(j)
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    out_a.append(self.digests[i])
                    out_b.append(self.digests[j])
                    group[group == group[j]] = group[i]
        return out_a, out_b


def _placed(documents: DataFrame, size: int, percent: int) -> DataFrame:
    """Per row: doc_id, n_shingles, digest, component (a digest), component_id (the smallest doc_id in it), and
    lead, the digest of the document that stands for the component. All but the first three are NULL for rows
    without an id or without words."""
    ship(documents.sparkSession)
    limit = most_odd_bits(percent / 100, SAMPLES, SKETCH_BITS)
    found = settle(features(documents.select("doc_id", "text"), size), "minhash-features")
    usable = found.where("doc_id is not null and digest is not null")
    classes = settle(
        usable.groupBy("digest").agg(F.min("doc_id").alias("id"), F.min("bands").alias("bands"), F.min("sketch").alias("sketch")),
        "minhash-classes",
    )
    banded = classes.select(F.explode("bands").alias("band"), "digest")
    crowded = settle(
        banded.groupBy("band").agg(F.min("digest").alias("low"), F.count("*").alias("n")).where("n > 1"), "minhash-bands"
    )
    members = settle(banded.join(crowded, "band"), "minhash-members")  # left side may be hot, right side is unique
    sketches = classes.select("digest", "sketch")
    stars = members.where("digest <> low").select(F.col("low").alias("a"), F.col("digest").alias("b")).distinct()
    stars = stars.join(sketches.select(F.col("digest").alias("b"), F.col("sketch").alias("sketch_b")), "b").join(
        sketches.select(F.col("digest").alias("a"), F.col("sketch").alias("sketch_a")), "a"
    )
    near = settle(_star_pairs(stars.select("a", "b", "sketch_a", "sketch_b"), limit), "minhash-stars")
    asked = classes.select("digest", "id").join(members.select("digest").distinct(), "digest", "left_semi")
    sets = settle(_sets(documents, settle(asked, "minhash-asked"), size), "minhash-sets")
    links = settle(_confirmed(near, sets, percent), "minhash-links")
    joined = connected_components(links, "minhash-first")
    # What the stars have left apart: bands whose classes are in more than one component.
    apart = members.join(joined.select(F.col("id").alias("digest"), "component"), "digest", "left").select(
        "band", "digest", F.coalesce("component", "digest").alias("component"), "n"
    )
    mixed = apart.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("band")
    apart = apart.join(mixed, "band").join(classes.select("digest", "bands", "sketch"), "digest")
    more = settle(_across(apart, sets, percent, limit), "minhash-across")
    linked = connected_components(links.union(more), "minhash-second").select(F.col("id").alias("digest"), "component")
    of_class = classes.select("digest", "id").join(linked, "digest", "left").select(
        "digest", "id", F.coalesce("component", "digest").alias("component")
    )
    first = of_class.groupBy("component").agg(F.min(F.struct("id", "digest")).alias("first"))
    whole = of_class.join(first, "component").select(
        "digest", "component", F.col("first.id").alias("component_id"), F.col("first.digest").alias("lead")
    )
    rows = found.select("doc_id", "n_shingles", "digest").join(whole, "digest", "left")
    known = [F.when(F.col("doc_id").isNotNull(), F.col(name)).alias(name) for name in ("component", "component_id", "lead")]
    return rows.select("doc_id", "n_shingles", "digest", *known)


def components(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``documents`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Rows are linked when the sets of their ``size``-word shingles have a Jaccard similarity of at least
    ``percent``/100. ``component_id`` is the smallest doc_id reachable, ``kept`` marks that row.
    Texts without words (NULL, empty) are linked with nothing. Rows without an id are linked with
    nothing, keep a NULL component and are kept. Rows that share an id are documents of their own: each is
    linked by its own text, and links of one are none of the other.
    """
    rows = _placed(documents, size, percent)
    root = F.coalesce("component_id", "doc_id")
    return rows.select(
        "doc_id", "n_shingles", root.alias("component_id"), F.coalesce(F.col("doc_id") == root, F.lit(True)).alias("kept")
    )


def drop_near_duplicates(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``documents`` without near-duplicates: of each group the document with the smallest id stays, and of those
    with the same smallest id the one with the smallest digest.

    Rows that repeat an id and a text are one document. Rows without an id or without words stay, but for
    rows that repeat an id and have no words either. Texts are not shuffled: the ids that go, and those that
    stand for more than one row, are looked up by a bitmap, and only what it marks is decided by a join.
    """
    rows = settle(_placed(documents, size, percent).where("doc_id is not null"), "minhash-placed")
    stays = F.coalesce((F.col("doc_id") == F.col("component_id")) & (F.col("digest") == F.col("lead")), F.lit(True))
    rows = rows.withColumn("stays", stays)
    ids = rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("stays").alias("stays"))
    special = settle(ids.where("n > 1 or not stays").select("doc_id", (F.col("n") > 1).alias("again")), "minhash-special")
    names = documents.columns
    flag, again = fresh(documents, "flag"), fresh(documents, "again")
    marked = flagged(documents, special, "doc_id", flag)
    untouched = marked.where(~F.col(flag)).select(*names)
    touched = marked.where(flag).join(special.withColumnRenamed("again", again), "doc_id", "left")
    false_hits = touched.where(F.col(again).isNull()).select(*names)
    # A repeated id: decided by the text, row by row.
    repeated = touched.where(again).select(*names)

    def kernel(texts: pa.Array) -> dict[str, list]:
        sets = [shingles(text, size) for text in texts.to_pylist()]
        return {"digest": [_digest(one) if len(one) else None for one in sets], "text": [text or "" for text in texts.to_pylist()]}

    key = fresh(documents, "digested")
    named = attach(repeated, ["text"], kernel, "digest binary, text string", key)
    wanted = rows.where("stays").join(special.where("again").select("doc_id"), "doc_id", "left_semi")
    wanted = wanted.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).distinct()
    same = (F.col("doc_id") == F.col("_id")) & F.col(f"{key}.digest").eqNullSafe(F.col("_digest"))
    one_each = named.join(wanted, same, "left_semi").withColumn(again, F.xxhash64(f"{key}.text")).dropDuplicates(["doc_id", again])
    return untouched.unionByName(false_hits).unionByName(one_each.select(*names))
