"""Repeated-passage removal with merged Burrows-Wheeler transforms.

A byte goes if a string of ``WINDOW`` bytes that covers it also starts earlier. To compare only what can
be equal, every window gets an anchor: the smallest of the hashes of its ``GRAM``-byte strings, leftmost
on ties. Equal windows have equal anchors in the same place, so

1. anchors of all documents are counted (combined before the shuffle); those met once are done with;
2. consecutive windows with one anchor form a record, the bytes they cover. Records whose anchor may be
   repeated, by a bitmap of bounded size, are dealt into groups by anchor. A false hit of the bitmap
   costs work, no result. An anchor with many occurrences (``hot``) is also dealt by document and place;
3. in a group, equal records are folded. The rest is cut into shards, each with its own suffix order and
   Burrows-Wheeler transform. The transforms are merged by refining their interleave: each round sorts
   the rows stably by the preceding byte, after round k the rows are ordered by their first k bytes, and
   block borders tell where common prefixes end. A row alone in its block is done. After ``WINDOW`` rounds a
   block of more than one window is a repeated interval. No suffixes are sorted again across shards;
4. hot anchors: each group reports the first place of every distinct window, and the smallest of
   these decides;
5. the spans go back to their documents. Only documents that may have spans, by a bitmap of ids, are
   shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressroom.llm.common import attach, bitmap, flagged, fresh, run_ends, settle, ship

WINDOW, GRAM = 100, 32
GROUP_BYTES = 4 << 20
MERGE_BYTES = 1 << 17  # of records merged at once: what fits a processor cache
SHARDS = 4
MOST_BITS = 28  # of the bitmap of anchors: 32 MB
HOT_LEAST, HOT_SHARE = 2_000, 100_000
_BLOCK = 1 << 22
_LOW = np.uint64((1 << 24) - 1)
_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def _grams(data: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hash of the ``gram`` bytes (a multiple of 8) from each place on."""
    n = len(data) - gram + 1
    words = np.ndarray((len(data) - 7,), "<u8", data.tobytes(), strides=(1,))
    out = np.full(n, gram, np.uint64)
    for i in range(gram // 8):
        out = (out ^ words[8 * i : 8 * i + n]) * _ODD[i % 4]
        out ^= out >> np.uint64(29)
    out *= _ODD[2]
    return out ^ (out >> np.uint64(32))


def records(data: bytes, window: int = WINDOW, gram: int = GRAM) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor, its place, first window, last window) of the runs of windows with one anchor, in blocks."""
    raw = np.frombuffer(data, np.uint8)
    width = window - gram + 1
    for start in range(0, len(data) - window + 1, _BLOCK):
        windows = min(_BLOCK, len(data) - window + 1 - start)
        hashes = _grams(raw[start : start + windows + window - 1], gram)
        lowest = (hashes & ~_LOW) | np.arange(len(hashes), dtype=np.uint64)
        span = 1
        while 2 * span <= width:
            lowest = np.minimum(lowest[:-span], lowest[span:])
            span *= 2
        lowest = np.minimum(lowest[:windows], lowest[width - span : width - span + windows])
        place = (lowest & _LOW).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        last = np.concatenate((first[1:] - 1, [windows - 1]))
        yield hashes[place[first]].view(np.int64), place[first] + start, first + start, last + start


def _counted(documents: DataFrame) -> DataFrame:
    """(anchor, n) of the anchors met more than once."""

    def kernel(texts: pa.Array) -> dict[str, list]:
        out = []
        for text in texts.to_pylist():
            parts = [anchors for anchors, *_ in records((text or "").encode())]
            out.append(np.concatenate([np.zeros(0, np.int64), *parts]))
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in out])))
        values = np.concatenate(out) if out else np.zeros(0, np.int64)
        return {"anchors": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64()))}

    found = attach(documents, ["text"], kernel, "anchors array<bigint>", "found", keep=[])
    return found.select(F.explode("found.anchors").alias("anchor")).groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")


def _marked(bits: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    place = numbers & (8 * len(bits) - 1)
    return (bits[place >> 3] >> (7 - (place & 7))) & 1 == 1


_RECORD = "array<struct<group_no:bigint, salt:int, anchor:bigint, first:bigint, last:bigint, bytes:binary>>"


def _dealt(documents: DataFrame, bits: np.ndarray, hot: dict[int, int], groups: int) -> DataFrame:
    """Per document: doc_id, version (hash of the text), records to compare, and spans repeated in itself."""
    shared = documents.sparkSession.sparkContext.broadcast((bits, hot))

    def kernel(texts: pa.Array) -> dict[str, list]:
        import xxhash

        marks, salts = shared.value
        out: dict[str, list] = {"version": [], "records": [], "own": []}
        for text in texts.to_pylist():
            data = (text or "").encode()
            version = xxhash.xxh3_64_intdigest(data)
            seen: set[tuple[int, bytes]] = set()
            rows, own = [], []
            for anchors, _, first, last in records(data):
                chosen = _marked(marks, anchors)
                for anchor, a, b in zip(anchors[chosen].tolist(), first[chosen].tolist(), last[chosen].tolist()):
                    body = data[a : b + WINDOW]
                    if (anchor, body) in seen:
                        own.append((a, b + WINDOW))
                        continue
                    seen.add((anchor, body))
                    # By document and place: one text may hold a hot anchor thousands of times.
                    salt = 1 + (version + a // WINDOW * 0x9E3779B1) % salts[anchor] if anchor in salts else 0
                    rows.append({"group_no": (anchor >> 8) % groups, "salt": salt, "anchor": anchor, "first": a, "last": b, "bytes": body})
            out["version"].append(version - (1 << 63))
            out["records"].append(rows)
            out["own"].append([x for run in run_ends(*zip(*own)) for x in run] if own else [])
        return out

    fields = f"version bigint, records {_RECORD}, own array<bigint>"
    return attach(documents, ["text"], kernel, fields, "d", keep=["doc_id"]).select("doc_id", "d.*")


class Shard:
    """Rows (suffixes) of some records in suffix order, and the byte before each of them."""

    def __init__(self, bodies: list[bytes]) -> None:
        m = len(bodies)
        sizes = np.array([len(b) + 1 for b in bodies])
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        raw = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8)
        text = raw.astype(np.int64) + m + 1
        ends = starts + sizes - 1
        text[ends] = np.arange(m)  # an end of its own for each record, below all bytes
        self.order = self._suffix_order(text)
        record = np.repeat(np.arange(m), sizes)
        self.record, self.offset = record[self.order], self.order - starts[record[self.order]]
        before = raw[self.order - 1] + np.uint8(1)  # UTF-8 has no byte 255
        before[self.offset == 0] = 0  # nothing stands before a record
        self.before, self.records = before, m

    @staticmethod
    def _suffix_order(text: np.ndarray) -> np.ndarray:
        n = len(text)
        _, key = np.unique(text, return_inverse=True)
        step = 1
        while True:
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
            if rank[order[-1]] == n - 1:
                return order
            following = np.zeros(n, np.int64)
            following[: n - step] = rank[step:] + 1
            key = rank * (n + 1) + following
            step *= 2


def merge(shards: list[Shard], rows: np.ndarray, depth: int, singles: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """``rows`` (numbered through all shards) after ``depth`` steps to the left, in the order of the bytes that they
    have stepped over, and their blocks: rows of one block have the same ``depth`` bytes.

    Each round sorts the rows stably by the byte before them and steps to their left neighbours, which
    every shard knows from its own transform. A row that is alone in its block stays alone, whatever stands to
    its left, so it is left out from then on, unless ``singles`` are asked for.
    """
    starts = np.concatenate(([0], np.cumsum([len(s.before) for s in shards])))
    before = np.concatenate([s.before for s in shards])
    left = np.empty(len(before), np.int32)
    for shard, start in zip(shards, starts):
        left[start + np.argsort(shard.before, kind="stable")] = start + np.arange(len(shard.before))
    rows, block = rows.astype(np.int32), np.zeros(len(rows), np.int32)
    for _ in range(depth):
        byte = before.take(rows)
        order = np.argsort(byte, kind="stable")
        byte, old = byte.take(order), block.take(order)
        rows = left.take(rows.take(order))
        first = np.ones(len(rows) + 1, bool)
        np.not_equal(byte[1:], byte[:-1], out=first[1:-1])
        first[1:-1] |= old[1:] != old[:-1]
        block = np.cumsum(first[:-1], dtype=np.int32)
        if not singles:
            alone = first[:-1] & first[1:]
            if 8 * np.count_nonzero(alone) > len(rows):
                rows, block = rows[~alone], block[~alone]
    if not singles and len(rows):
        first = np.concatenate(([True], block[1:] != block[:-1], [True]))
        rows, block = rows[~(first[:-1] & first[1:])], block[~(first[:-1] & first[1:])]
    return rows.astype(np.int64), block


def repeated_windows(bodies: list[bytes], windows: np.ndarray, singles: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(record, offset, interval) of the windows: equal numbers are equal strings. Windows that are met once are
    left out, unless ``singles`` are asked for.

    ``windows``: how many windows each record has, from its start on.
    """
    count = max(1, min(SHARDS, len(bodies)))
    cuts = np.linspace(0, len(bodies), count + 1).astype(int)
    shards = [Shard(bodies[a:b]) for a, b in zip(cuts, cuts[1:]) if a < b]
    record = np.concatenate([s.record + a for s, a in zip(shards, cuts)])
    offset = np.concatenate([s.offset for s in shards])
    # A window is found from its end, WINDOW steps to the left: one row for each window starts there.
    placed, block = merge(shards, np.flatnonzero(offset >= WINDOW), WINDOW, singles)
    record, offset = record[placed], offset[placed]
    keep = offset < windows[record]
    return record[keep], offset[keep], block[keep]


def _group(rows: pa.Table) -> pa.Table:
    """Spans to remove (key NULL), and for hot anchors the first place of each window (with its key)."""
    out: dict[str, list] = {"doc_id": [], "version": [], "first": [], "end": [], "key": []}

    def tell(where: tuple, first: int, end: int, key: int | None = None) -> None:
        for name, value in zip(out, (*where, first, end, key)):
            out[name].append(value)

    salted = rows["salt"][0].as_py() > 0
    by_anchor: dict[int, dict[bytes, tuple]] = {}
    columns = [rows[c].to_pylist() for c in ("anchor", "bytes", "doc_id", "version", "first", "last")]
    for anchor, body, doc, version, first, last in sorted(zip(*columns), key=lambda r: (r[2], r[3], r[4])):
        held = by_anchor.setdefault(anchor, {})
        if body in held:
            if held[body][:2] != (doc, version) or held[body][2] != first:
                tell((doc, version), first, last + WINDOW)
        else:
            held[body] = (doc, version, first, last)

    def settle_batch(batch: list[tuple[int, bytes, tuple]]) -> None:
        bodies = [body for _, body, _ in batch]
        windows = np.array([last - first + 1 for _, _, (_, _, first, last) in batch])
        record, offset, interval = repeated_windows(bodies, windows, salted)
        if not len(record):
            return
        # batch is in the order of (document, place) inside an anchor, so the smallest record is the first
        order = np.lexsort((offset, record, interval))
        record, offset, interval = record[order], offset[order], interval[order]
        leads = np.concatenate(([True], interval[1:] != interval[:-1]))
        gone = ~leads
        where = np.lexsort((offset[gone], record[gone]))
        r, o = record[gone][where].tolist(), offset[gone][where].tolist()
        start = 0
        for i in range(1, len(r) + 1):  # neighbouring windows of a record are one span
            if i == len(r) or r[i] != r[start] or o[i] != o[i - 1] + 1:
                doc, version, first, _ = batch[r[start]][2]
                tell((doc, version), first + o[start], first + o[i - 1] + WINDOW)
                start = i
        if salted:
            import xxhash

            for i, j in zip(record[leads].tolist(), offset[leads].tolist()):
                anchor, body, (doc, version, first, _) = batch[i]
                key = xxhash.xxh3_64_intdigest(body[j : j + WINDOW], anchor & 0xFFFFFFFF) - (1 << 63)
                tell((doc, version), first + j, first + j + WINDOW, key)

    batch, held_bytes = [], 0
    for anchor, held in by_anchor.items():
        if len(held) == 1 and not salted:
            continue
        if held_bytes > MERGE_BYTES:
            settle_batch(batch)
            batch, held_bytes = [], 0
        batch += [(anchor, body, place) for body, place in held.items()]
        held_bytes += sum(map(len, held))
    if batch:
        settle_batch(batch)
    kinds = {"doc_id": pa.int64(), "version": pa.int64(), "first": pa.int64(), "end": pa.int64(), "key": pa.int64()}
    return pa.table({name: pa.array(out[name], kind) for name, kind in kinds.items()})


def repeated_spans(documents: DataFrame) -> DataFrame:
    """(doc_id, version, spans): flattened byte ranges to remove, for documents that have any."""
    ship(documents.sparkSession)
    named = documents.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    anchors = settle(_counted(named), "suffix-anchors")
    total, distinct = anchors.agg(F.sum("n"), F.count("*")).first()
    total = total or 0
    limit = max(HOT_LEAST, total // HOT_SHARE)  # so at most HOT_SHARE anchors are hot
    hot = {row.anchor: 1 + row.n // limit for row in anchors.where(F.col("n") >= limit).collect()}
    bits = bitmap(anchors, "anchor", distinct, MOST_BITS)
    groups = 1 + total * 140 // GROUP_BYTES
    dealt = settle(_dealt(named, bits, hot, groups), "suffix-records")
    compared = (
        dealt.select("doc_id", "version", F.explode("records").alias("r"))
        .select("doc_id", "version", "r.*")
        .groupBy("group_no", "salt")
        .applyInArrow(lambda rows: _group(rows), "doc_id bigint, version bigint, first bigint, end bigint, key bigint")
    )
    compared = settle(compared, "suffix-compared")
    firsts = compared.where("key is not null")
    place = F.struct("doc_id", "version", "first")
    lowest = firsts.groupBy("key").agg(F.min(place).alias("lowest"), F.count("*").alias("n")).where("n > 1")
    later = firsts.join(lowest, "key").where(place > F.col("lowest"))
    spans = compared.where("key is null").select("doc_id", "version", "first", "end").union(
        later.select("doc_id", "version", "first", "end")
    )
    own = dealt.where(F.size("own") > 0).select("doc_id", "version", "own")
    own = own.select("doc_id", "version", F.explode(F.sequence(F.lit(0), F.size("own") - 2, F.lit(2))).alias("i"), "own").select(
        "doc_id", "version", F.col("own")[F.col("i")].alias("first"), F.col("own")[F.col("i") + 1].alias("end")
    )
    return spans.union(own).groupBy("doc_id", "version").agg(F.array_sort(F.collect_set(F.struct("first", "end"))).alias("spans"))


def remove_repeats(documents: DataFrame) -> DataFrame:
    """Per row of ``documents`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept.

    ``kept``: the remaining bytes where bytes were removed, else NULL. NULL and empty texts have no
    bytes. Rows with a NULL id lose nothing and repeat nothing. Rows that share an id are documents of
    their own, ordered by a hash of the text; equal rows are one document, in more than one row.
    """
    spark = documents.sparkSession
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    spans = settle(repeated_spans(documents), "suffix-spans")
    marked = flagged(rows, spans.select("doc_id").distinct(), "doc_id")
    untouched = marked.where("not flag").select(
        "doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.lit(0).cast("bigint").alias("n_removed"),
        F.lit(0).cast("bigint").alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), F.lit(None).cast("binary").alias("kept"),
    )

    def version(texts: pa.Array) -> dict[str, list]:
        import xxhash

        return {"version": [xxhash.xxh3_64_intdigest(t.encode()) - (1 << 63) for t in texts.to_pylist()]}

    touched = attach(marked.where("flag").select("doc_id", "text"), ["text"], version, "version bigint", "v")
    touched = touched.select("doc_id", "text", "v.version").join(spans, ["doc_id", "version"], "left")

    def cut(texts: pa.Array, found: pa.Array) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        for text, pairs in zip(texts.to_pylist(), found.to_pylist()):
            data = text.encode()
            runs = run_ends([p["first"] for p in pairs], [p["end"] for p in pairs]) if pairs else []
            parts, last = [], 0
            for first, end in runs:
                parts.append(data[last:first])
                last = end
            kept = b"".join([*parts, data[last:]])
            for name, value in zip(out, (len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept if runs else None)):
                out[name].append(value)
        return out

    fields = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    done = attach(touched, ["text", "spans"], cut, fields, fresh(touched, "cut"), keep=["doc_id"]).select("doc_id", "cut.*")
    return untouched.union(done)
