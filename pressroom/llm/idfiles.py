"""Token ids as raw files, with a minimal perfect hash from document keys to their place.

A folder in this format holds

* ``ids-<shard>.bin``: nothing but little-endian ids, of two bytes if the vocabulary allows it, else four.
  The documents of all shards, one after the other, stand in ascending order of their key;
* ``index-<bucket>.mph``: keys by hash, some ``BUCKET_KEYS`` in a bucket. Each is a minimal perfect hash with
  a fingerprint, shard, offset and length in every slot (``perfect_hash``); keys themselves are not stored;
* ``manifest``: Parquet, one row per shard: ids before it, ids and documents in it, width, buckets.

A key leads to its ids by one bucket and one range of a file (``IdFiles.get``), in constant time. ``lookup``
does so for a whole DataFrame of keys, every bucket and every shard being read by one task.

Texts are ranged and sorted by Spark, encoded in the sorted tasks, and written as a stream: no document
but the current ones is in memory. A task writes under a name of its own and renames at its end, and the same rows
give the same file, so a task that runs again after a loss does no harm. The folder is reached through
pyarrow's file systems (mounted paths, S3, GCS, HDFS).

Repeated keys: copies of a key are numbered from 0 in the order in which they are written (by a hash of the
text, then the text). A NULL key is a key, and comes first; a NULL text is an empty one.
"""

from __future__ import annotations

import functools
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressroom.llm import perfect_hash
from pressroom.llm.common import SLICE_BYTES, attach, settle, ship

BUCKET_KEYS = 100_000
CACHED_WORDS = 600_000
_MARKS = (b"\xcc", b"\xcd")  # first bytes of U+0300 to U+037F, where the marks are that join an ASCII letter
# Letters without capitals and without marks to join, then a run of other signs: two pieces.
_PLAIN = re.compile(r"([a-z\u00df-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]*)")


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte: itself where it can be seen, else the next one from 256 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [byte for byte in range(256) if byte not in seen]
    return {byte: byte for byte in seen} | {byte: 256 + i for i, byte in enumerate(others)}


class Encoder:
    """Ids by a file of the tokenizers library, without added special tokens; their strings are ordinary text.

    A tokenizer that drops white space, folds capitals and tells letters from other signs (``by_words``, read
    off the file) encodes every run between ASCII white space by itself, so each is encoded once and remembered,
    at most ``CACHED_WORDS`` beyond those of the last texts. Where no mark can join a letter, A-Z are folded
    before the look-up. Runs of plain letters go straight to the library's model. Any other tokenizer gets
    whole texts.
    """

    def __init__(self, file: str, by_words: bool | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.encode_special_tokens = True
        self.by_words = self._splits_at_white_space() if by_words is None else by_words
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known: dict[bytes, bytes] = {}
        self.letters = _byte_letters()

    def _splits_at_white_space(self) -> bool:
        made = json.loads(self.tokenizer.to_str())
        folds = [step["type"] for step in (made["normalizer"] or {}).get("normalizers", [])]
        splits = (made["pre_tokenizer"] or {}).get("pretokenizers", [])
        pattern = [(step["pattern"].get("Regex"), step["behavior"], step["invert"]) for step in splits if step["type"] == "Split"]
        lone = [step for step in splits if step["type"] == "ByteLevel" and not step["add_prefix_space"] and not step["use_regex"]]
        words = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        return folds == ["NFC", "Replace", "Lowercase"] and pattern == [(words, "Removed", True)] and len(splits) == 2 and len(lone) == 1

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(one.ids, self.kind).tobytes() for one in found]

    def _learn(self, words: set[bytes]) -> None:
        """Remember the ids of ``words``."""
        known, model, letters, width = self.known, self.tokenizer.model, self.letters, self.kind.itemsize
        others, marked = [], []
        for word in words:
            plain = _PLAIN.fullmatch(word.decode())
            if not plain:
                others.append(word)
                continue
            run, marks = plain.groups()
            piece = run if run.isascii() else run.encode().decode("latin-1").translate(letters)
            known[word] = b"".join([token.id.to_bytes(width, "little") for token in model.tokenize(piece)])
            if marks:
                marked.append((word, marks.encode()))
        runs = {marks for _, marks in marked if marks not in known}.difference(others)
        for start in range(0, len(batch := [*others, *runs]), 10_000):
            part = batch[start : start + 10_000]
            known.update(zip(part, self._ids([word.decode() for word in part])))
        for word, marks in marked:
            known[word] += known[marks]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_words:
            return self._ids(texts)
        split = []
        for text in texts:
            raw = text.encode()
            split.append((raw if any(mark in raw for mark in _MARKS) else raw.lower()).split())
        words = set().union(*split)
        self._learn(words.difference(self.known))
        found = [b"".join(map(self.known.__getitem__, row)) for row in split]
        if len(self.known) > CACHED_WORDS:
            self.known = {word: self.known[word] for word in words}
        return found


@functools.lru_cache(maxsize=1)
def _encoder(file: str) -> Encoder:
    return Encoder(file)


def _place(path: str):
    """File system and path of a folder."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class _Output:
    """A file that appears under its name when it is complete."""

    def __init__(self, folder: str, name: str):
        self.system, base = _place(folder)
        self.system.create_dir(base, recursive=True)
        self.name, self.draft = f"{base}/{name}", f"{base}/_{name}-{uuid.uuid4().hex}"
        self.stream = self.system.open_output_stream(self.draft)
        self.write = self.stream.write

    def done(self) -> None:
        self.stream.close()
        self.system.move(self.draft, self.name)


def _name(kind: str, number: int) -> str:
    return f"ids-{number:05d}.bin" if kind == "ids" else f"index-{number:05d}.mph"


def key_words(key, copy: int) -> tuple[int, int]:
    """The two 64-bit words that stand for a key."""
    import xxhash

    said = (b"\xff" if key is None else str(key).encode()) + b"\0%d" % copy
    both = xxhash.xxh3_128_intdigest(said)
    return both >> 64, both & (2**64 - 1)


def _encoded(documents: DataFrame, folder: str, file: str, end_id: int, key: str, text: str) -> DataFrame:
    """Writes the shards; (key, shard, row, place, n_ids) of every document."""
    read = documents.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = [F.col("key"), F.xxhash64("text")]
    ranged = read.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    placed = ranged.withColumn("shard", F.spark_partition_id())
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(file)
        end = np.array([end_id], encoder.kind).tobytes()
        out, row, place = None, 0, 0
        for batch in batches:
            texts = batch["text"].to_pylist()
            first = 0
            while first < len(texts):
                last, held = first, 0
                while last < len(texts) and (last == first or held < SLICE_BYTES):
                    held += len(texts[last])
                    last += 1
                found = encoder.encode(texts[first:last])
                out = out or _Output(folder, _name("ids", batch["shard"][0].as_py()))
                for ids in found:
                    out.write(ids)
                    out.write(end)
                sizes = np.array([len(ids) // encoder.kind.itemsize + 1 for ids in found], np.int64)
                part = batch.slice(first, last - first)
                columns = [part["key"], part["shard"], row + np.arange(len(sizes)), place + np.cumsum(sizes) - sizes, sizes]
                yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns],
                                      ["key", "shard", "row", "place", "n_ids"])
                row, place, first = row + len(sizes), place + int(sizes.sum()), last
        if out:
            out.done()

    return placed.mapInArrow(run, f"key {kind}, shard int, row bigint, place bigint, n_ids bigint")


def write(
    documents: DataFrame,
    folder: str,
    file: str,
    end_id: int,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Write ``documents`` to the new folder ``folder``; returns the keys that were written: key, copy.

    ``end_id`` is appended to every document. Columns other than ``key`` and ``text`` are not read.
    """
    spark = documents.sparkSession
    ship(spark)
    located = settle(_encoded(documents, folder, file, end_id, key, text), "ids-places")
    # One row per task of the writing job.
    shards = sorted(located.groupBy("shard").agg(F.count("*"), F.sum("n_ids")).collect())
    rows = ids = 0
    manifest = []
    kind = _encoder(file).kind.itemsize
    buckets = 1 + sum(n for _, n, _ in shards) // BUCKET_KEYS
    for shard, n, total in shards:
        manifest.append((shard, rows, ids, n, total, kind, buckets))
        rows, ids = rows + n, ids + total
    fields = "shard int, docs_before bigint, ids_before bigint, n_docs bigint, n_ids bigint, width int, buckets int"
    table = spark.createDataFrame(manifest, fields)
    table.coalesce(1).write.parquet(f"{folder}/manifest")
    # Copies of a key stand one after the other: the first one's row gives the others their number.
    numbered = located.join(F.broadcast(table.select("shard", "docs_before")), "shard").withColumn("at", F.col("row") + F.col("docs_before"))
    again = numbered.groupBy("key").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("key_"), "first")
    keyed = numbered.join(again, F.col("key").eqNullSafe(F.col("key_")), "left").select(
        "key", F.coalesce(F.col("at") - F.col("first"), F.lit(0)).cast("bigint").alias("copy"), "shard", "place", "n_ids"
    )
    keyed = settle(_hashed(keyed, buckets), "ids-keys")

    def index(rows: pa.Table) -> pa.Table:
        high, low = (rows[name].to_numpy().view(np.uint64) for name in ("high", "low"))
        values = {"shard": rows["shard"].to_numpy().astype("<u4")} | {n: rows[n].to_numpy().astype("<u8") for n in ("place", "n_ids")}
        number = rows["bucket"][0].as_py()
        out = _Output(folder, _name("index", number))
        out.write(perfect_hash.packed(high, low, values))
        out.done()
        return pa.table({"bucket": pa.array([number], pa.int32()), "keys": pa.array([len(high)], pa.int64())})

    columns = keyed.select("bucket", "high", "low", "shard", "place", "n_ids")
    settle(columns.groupBy("bucket").applyInArrow(index, "bucket int, keys bigint"), "ids-index")
    return keyed.select("key", "copy")


def _hashed(keys: DataFrame, buckets: int) -> DataFrame:
    """``keys`` (key, copy, ...) with the words of the key and its bucket."""

    def kernel(key: pa.Array, copy: pa.Array) -> dict[str, np.ndarray]:
        both = [key_words(k, c) for k, c in zip(key.to_pylist(), copy.to_pylist())]
        words = np.array(both, np.uint64).reshape(-1, 2)
        return {"high": words[:, 0].view(np.int64), "low": words[:, 1].view(np.int64),
                "bucket": (words[:, 0] % np.uint64(buckets)).astype(np.int32)}

    return attach(keys, ["key", "copy"], kernel, "high bigint, low bigint, bucket int", "h").select(*keys.columns, "h.*")


@functools.lru_cache(maxsize=2)
def _index(folder: str, bucket: int) -> perfect_hash.Index | None:
    from pyarrow import fs

    system, base = _place(folder)
    path = f"{base}/{_name('index', bucket)}"
    if system.get_file_info(path).type == fs.FileType.NotFound:
        return None  # no key has fallen into it
    with system.open_input_file(path) as file:
        return perfect_hash.Index(file.read())


def lookup(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """key, copy, shard, place, n_ids for rows ``key, copy``; NULLs for a key that is not in the folder."""
    ship(spark)
    manifest = spark.read.parquet(f"{folder}/manifest")
    first = manifest.first()
    kind = keys.schema["key"].dataType.simpleString()

    def find(rows: pa.Table) -> pa.Table:
        high, low = (rows[name].to_numpy().view(np.uint64) for name in ("high", "low"))
        index = _index(folder, rows["bucket"][0].as_py())
        slots = index.find(high, low) if index else np.full(len(high), -1)
        columns = {"key": rows["key"], "copy": rows["copy"]}
        for name, form in (("shard", pa.int32()), ("place", pa.int64()), ("n_ids", pa.int64())):
            found = index.values[name][slots].astype(np.int64) if index else slots
            columns[name] = pa.array(found, form, mask=slots < 0)
        return pa.table(columns)

    found = _hashed(keys.select("key", "copy"), first.buckets if first else 1)
    return found.groupBy("bucket").applyInArrow(find, f"key {kind}, copy bigint, shard int, place bigint, n_ids bigint")


def read(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """key, copy, start (ids of all documents before it), n_tokens, ids_crc32 of the keys found, from the files.

    The checksum is that of the ids as little-endian unsigned 32-bit numbers.
    """
    manifest = spark.read.parquet(f"{folder}/manifest").select("shard", "ids_before", "width")
    found = lookup(spark, folder, keys).where("shard is not null").join(F.broadcast(manifest), "shard")
    kind = keys.schema["key"].dataType.simpleString()
    dealt = found.repartition("shard").sortWithinPartitions("shard", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _place(folder)
        opened, file = None, None
        for batch in batches:
            sums = []
            for shard, place, n, width in zip(*(batch[c].to_pylist() for c in ("shard", "place", "n_ids", "width"))):
                if shard != opened:
                    if file:
                        file.close()
                    opened, file = shard, system.open_input_file(f"{base}/{_name('ids', shard)}")
                ids = np.frombuffer(file.read_at(n * width, place * width), f"<u{width}")
                sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
            start = batch["place"].to_numpy() + batch["ids_before"].to_numpy()
            yield pa.record_batch([batch["key"], batch["copy"], pa.array(start), batch["n_ids"], pa.array(sums, pa.int64())],
                                  ["key", "copy", "start", "n_tokens", "ids_crc32"])
        if file:
            file.close()

    columns = dealt.select("key", "copy", "shard", "place", "n_ids", "width", "ids_before")
    return columns.mapInArrow(run, f"key {kind}, copy bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


class IdFiles:
    """Keyed access for a single process, such as a trainer's loader."""

    def __init__(self, folder: str):
        import pyarrow.parquet as pq

        self.folder = folder
        self.system, self.base = _place(folder)
        rows = pq.read_table(f"{self.base}/manifest", filesystem=self.system).to_pylist()
        self.shards = {row["shard"]: row for row in rows}

    def get(self, key, copy: int = 0) -> np.ndarray | None:
        """Ids of the document, None if the key is not there."""
        if not self.shards:
            return None
        any_shard = next(iter(self.shards.values()))
        high, low = key_words(key, copy)
        index = _index(self.folder, high % any_shard["buckets"])
        slot = int(index.find(np.array([high], np.uint64), np.array([low], np.uint64))[0]) if index else -1
        if slot < 0:
            return None
        shard, place, n = (int(index.values[c][slot]) for c in ("shard", "place", "n_ids"))
        width = any_shard["width"]
        with self.system.open_input_file(f"{self.base}/{_name('ids', shard)}") as file:
            return np.frombuffer(file.read_at(n * width, place * width), f"<u{width}")
