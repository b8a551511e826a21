"""Helpers that the operators of this folder share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from pressroom.session import give_back, settle, shared_path, ship

__all__ = ["settle", "ship", "table", "attach", "fresh", "bitmap", "flagged", "connected_components", "run_ends", "scratch_folder", "give_back"]

SLICE_BYTES = 4 << 20  # lists of Python objects made from a slice take several times as much
SLICE_ROWS = 5_000
ID_BITS = 24  # of a bitmap of ids: 2 MB
_PAGE = 15  # bits of a bitmap's page number are those above


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the settled tables, for files; it goes when they go."""
    path = shared_path(spark, name)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or that name with underscores in front if ``df`` has such a column (in any case)."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def attach(
    df: DataFrame,
    inputs: list[str],
    kernel: Callable[..., dict[str, Sequence]],
    fields: str,
    name: str,
    keep: Sequence[str] | None = None,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """Columns ``keep`` (default: all) of every row, and the kernel's result as the struct ``name``.

    The kernel gets the ``inputs`` of a slice of rows as Arrow arrays and returns one value per row for
    each of ``fields`` (DDL). No row moves. A slice ends at ``slice_bytes`` of the first input, so memory is
    bounded by that and by the longest single value, whatever the session's batch size is.
    """
    spark = df.sparkSession
    ship(spark)
    keep = df.columns if keep is None else list(keep)
    read = df.select(*keep, *[F.col(column).alias(f"{name}__{i}") for i, column in enumerate(inputs)])
    result = StructType([StructField(name, StructType.fromDDL(fields))])
    out = StructType(df.select(*keep).schema.fields + result.fields)
    kind = to_arrow_schema(result).field(0).type
    first, names = len(keep), [*keep, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _attached(batches, kernel, first, names, kind, slice_bytes)
        give_back()  # the worker may wait for its next task for long

    return read.mapInArrow(run, out)


def _attached(
    batches: Iterator[pa.RecordBatch], kernel: Callable[..., dict[str, Sequence]], first: int, names: list[str], kind: pa.DataType, slice_bytes: int
) -> Iterator[pa.RecordBatch]:
    """Batches with the kernel's results; what a kernel returned is let go before it gets its next slice."""

    def result(part: pa.RecordBatch) -> pa.RecordBatch:
        found = kernel(*part.columns[first:])
        arrays = [a if isinstance(a := found.pop(f.name), pa.Array) else pa.array(a, f.type, from_pandas=False) for f in kind]
        return pa.record_batch([*part.columns[:first], pa.StructArray.from_arrays(arrays, fields=list(kind))], names)

    for batch in batches:
        for start, rows in _slices(batch.column(first), slice_bytes):
            yield result(batch.slice(start, rows))


def _slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    else:
        sizes = [0] * len(column)
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and (held + size > most or i - start >= SLICE_ROWS):
            yield start, i - start
            start, held = i, 0
        held += size
    if len(sizes) > start:
        yield start, len(sizes) - start


def bitmap(numbers: DataFrame, column: str, count: int, most_bits: int) -> np.ndarray:
    """Bits of the low digits of ``column`` (well mixed numbers); its size follows ``count`` up to ``most_bits``."""
    bits = min(most_bits, max(_PAGE, (16 * count).bit_length()))
    place = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    pages = numbers.select(F.shiftright(place, _PAGE).alias("page"), place.bitwiseAND(F.lit((1 << _PAGE) - 1)).cast("int").alias("bit")).distinct()

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        ones = np.zeros(1 << _PAGE, np.uint8)
        ones[rows["bit"].to_numpy()] = 1
        return pa.table({"page": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(ones).tobytes()], pa.binary())})

    out = np.zeros(1 << (bits - 3), np.uint8)
    for row in pages.groupBy("page").applyInArrow(pack, "page bigint, bits binary").toLocalIterator():
        out[row.page << (_PAGE - 3) : (row.page + 1) << (_PAGE - 3)] = np.frombuffer(row.bits, np.uint8)
    return out


def flagged(rows: DataFrame, ids: DataFrame, key: str, flag: str = "flag") -> DataFrame:
    """``rows`` with a boolean ``flag``: may their ``key`` be among ``ids``? Never false for one that is.

    The bitmap of the ids is a table of 64 bits a row, at most 4 MB, and is looked up where the rows stand. When
    it is full, more rows are flagged, and the exact join behind it has more to do.
    """
    spark = rows.sparkSession
    mixed = F.xxhash64(F.col(key).cast("bigint"))
    marks = bitmap(ids.select(F.xxhash64(F.col(ids.columns[0]).cast("bigint")).alias("mark")).distinct(), "mark", ids.count(), ID_BITS)
    words = np.packbits(np.unpackbits(marks), bitorder="little").view("<i8")
    word, bits = fresh(rows, "word"), fresh(rows, "bits")
    numbers = [(i, int(words[i])) for i in np.flatnonzero(words).tolist()]
    table = spark.createDataFrame(numbers, f"{word} bigint, {bits} bigint")
    spot = mixed.bitwiseAND(F.lit(8 * len(marks) - 1))
    placed = rows.withColumn(word, F.shiftright(spot, 6)).join(F.broadcast(table), word, "left")
    one = F.expr(f"shiftright({bits}, cast(xxhash64(cast(`{key}` as bigint)) & 63 as int)) & 1") == 1
    return placed.select(*rows.columns, F.coalesce(one, F.lit(False)).alias(flag))


def run_ends(starts, ends):
    """Merge intervals that are sorted by start: overlapping and touching ones become one."""
    merged: list[list[int]] = []
    for start, end in zip(starts, ends):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    return merged


def connected_components(links: DataFrame, name: str = "components") -> DataFrame:
    """Smallest reachable id of every node of an undirected graph.

    ``links`` has columns a, b of one type that can be ordered. Returns (id, component) for every id in it. Alternating
    large-star and small-star rounds (Kiveris et al., 2014): each is one grouped minimum and one
    join, the number of rounds grows with the logarithm of the graph. A node's neighbours are
    never gathered; the minimum is combined before the shuffle. Each round is settled.
    """

    def both(edges: DataFrame) -> DataFrame:
        return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def star(directed: DataFrame, large: bool) -> DataFrame:
        lowest = directed.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = directed.join(lowest, "a")
        if large:
            edges = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            edges = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
                lowest.select("a", F.col("m").alias("b"))
            )
        return edges.where("a <> b")

    edges = settle(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name
    )
    size = _mark(edges)
    while True:
        edges = settle(star(star(both(edges), large=True), large=False).distinct(), name)
        mark = _mark(edges)
        if mark == size:
            break
        size = mark
    roots = edges.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("id"), "component")
    return roots.union(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Number and order-free digest of the edges: two equal marks mean that a round changed nothing."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)
