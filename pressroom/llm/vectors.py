"""Embedding near-duplicates by int8 tile products with error bounds.

Equal vectors are one class; only one of them is compared. Classes are dealt to pivots (a sample of the
vectors, one for each ``TILE`` of them, at most ``PIVOTS`` of each size) and, by a hash, into tiles of at most about
``TILE`` vectors: a vector meets no more tiles than its table has. Two pivots whose
vectors cannot be near (the angle between the centres minus both radii is above the threshold angle)
are not compared. Every other pair of tiles is one task:

* each unit vector x is s*q with q in int8 and a known error e = |x - s*q|, so a cosine is within
  e_x + e_y + e_x*e_y of the scaled product of the integers, which is exact in float arithmetic;
* only pairs that may reach the threshold under that bound are computed in double precision;
* the task returns, for each vector with links, how many vectors it is linked with and the smallest id
  of its part of the tile graph: never the pairs, so a group of near copies costs no quadratic output.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pressroom.llm.common import attach, connected_components, settle, ship
from pressroom.operators.ranking import first_n_per_key

THRESHOLD = 0.9
TILE = 4096
PIVOTS = 64
STRIPE = 256
SLACK = 2e-6  # rounding of the scaled product in single precision


def _keyed(embeddings: DataFrame) -> DataFrame:
    """vec_id, key and vector (doubles as bytes); both NULL for vectors that link with nothing."""

    def kernel(vectors: pa.Array) -> dict[str, list]:
        keys, out = [], []
        for value in vectors.to_pylist():
            good = bool(value) and None not in value
            x = np.array(value, np.float64) if good else None
            if good and np.isfinite(x).all() and x.any():
                x = x / np.abs(x).max()  # lengths neither overflow nor vanish
                keys.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
                out.append(x.tobytes())
            else:
                keys.append(None)
                out.append(None)
        return {"key": keys, "vector": out}

    # With an id only: a row that cannot be named is linked with nothing.
    vector = F.when(F.col("vec_id").isNotNull(), F.col("embedding")).alias("embedding")
    read = embeddings.select("vec_id", vector)
    return attach(read, ["embedding"], kernel, "key binary, vector binary", "v", keep=["vec_id"]).select("vec_id", "v.*")


def _matrix(vectors: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1)


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _with_pivot(classes: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Classes with the number of their nearest pivot and the angle to it."""
    shared = classes.sparkSession.sparkContext.broadcast(pivots)

    def kernel(column: pa.Array) -> dict[str, list]:
        vectors = column.to_pylist()
        place, angle = [0] * len(vectors), [0.0] * len(vectors)
        by_size: dict[int, list[int]] = {}
        for i, v in enumerate(vectors):
            by_size.setdefault(len(v), []).append(i)
        for size, rows in by_size.items():
            cosines = _units(_matrix([vectors[i] for i in rows])) @ shared.value[size].T
            best = cosines.argmax(axis=1)
            for i, b, c in zip(rows, best.tolist(), cosines.max(axis=1).tolist()):
                place[i], angle[i] = b, math.acos(min(1.0, max(-1.0, c)))
        return {"pivot": place, "angle": angle}

    return attach(classes, ["vector"], kernel, "pivot int, angle double", "p").select(*classes.columns, "p.*")


class _Tile:
    def __init__(self, ids: np.ndarray, weights: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.weights, self.unit = ids, weights, _units(vectors)
        self.scale = np.abs(self.unit).max(axis=1, keepdims=True) / 127
        self.quantised = np.rint(self.unit / self.scale).astype(np.int8)
        self.error = np.linalg.norm(self.unit - self.scale * self.quantised, axis=1) + 1e-12


def _links(left: _Tile, right: _Tile, same: bool, threshold: float):
    """(rows, columns) of the pairs with a cosine of at least the threshold."""
    columns = right.quantised.astype(np.float32).T  # integers below 2**24: products are exact
    scale = right.scale[:, 0].astype(np.float32)
    for start in range(0, len(left.ids), STRIPE):
        rows = slice(start, start + STRIPE)
        product = left.quantised[rows].astype(np.float32) @ columns
        product *= scale
        product *= left.scale[rows].astype(np.float32)
        own = left.error[rows, None]
        product += ((1 + own.max()) * right.error).astype(np.float32)
        i, j = np.nonzero(product >= (threshold - SLACK - own).astype(np.float32))
        i += start
        if same:
            i, j = i[i < j], j[i < j]
        for part in range(0, len(i), 50_000):
            a, b = i[part : part + 50_000], j[part : part + 50_000]
            near = np.einsum("ij,ij->i", left.unit[a], right.unit[b]) >= threshold
            yield a[near], b[near]


def _compare(rows: pa.Table, same: bool, threshold: float) -> pa.Table:
    home = rows["home"].to_numpy(zero_copy_only=False).astype(bool)
    ids, weights = rows["id"].to_numpy(), rows["n"].to_numpy()
    vectors = _matrix(rows["vector"].to_pylist())
    tiles = [_Tile(ids[m], weights[m], vectors[m]) for m in ((home, home) if same else (home, ~home))]
    left, right = tiles
    counts = [np.zeros(len(t.ids), np.int64) for t in tiles]
    root = ids.copy()
    places = [np.flatnonzero(home), np.flatnonzero(home if same else ~home)]
    for a, b in _links(left, right, same, threshold):
        np.add.at(counts[0], a, right.weights[b])
        np.add.at(counts[1], b, left.weights[a])
        x, y = places[0][a], places[1][b]
        while True:  # smallest id of each part; of these pairs on top of those seen so far
            lower = np.minimum(root[x], root[y])
            if (root[x] == lower).all() and (root[y] == lower).all():
                break
            before = np.concatenate((root[x], root[y]))
            after = np.concatenate((lower, lower))
            order = np.lexsort((after, before))
            names, first = np.unique(before[order], return_index=True)
            spot = np.minimum(np.searchsorted(names, root), len(names) - 1)
            root = np.where(names[spot] == root, after[order][first][spot], root)
    total = np.zeros(len(ids), np.int64)
    np.add.at(total, places[0], counts[0])
    np.add.at(total, places[1], counts[1])
    keep = total > 0
    return pa.table({"id": ids[keep], "n": total[keep], "root": root[keep]})


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """Per row of ``embeddings`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    A vector that is NULL, empty, zero, or holds NULL or non-finite components links with nothing;
    vectors of different lengths do not link. Rows with a NULL id link with nothing, have no component
    and are kept. Repeated rows, and rows that share an id, count as vectors of their own: each is linked by its
    own components, and links of one are none of the other.
    """
    spark = embeddings.sparkSession
    ship(spark)
    keyed = settle(_keyed(embeddings), "vectors")
    grouped = keyed.where("key is not null").groupBy("key").agg(
        F.min("vec_id").alias("vec_id"), F.count("*").alias("n"), F.min("vector").alias("vector")
    )
    # Written once, so these numbers are fixed; an id may stand for more than one class.
    classes = settle(grouped.withColumn("id", F.monotonically_increasing_id()), "vector-classes")
    size = F.length("vector")
    # Sizes of vectors are a property of the model that made them: mostly one. All pivots come in one job.
    rows_of = {row.size: row["count"] for row in classes.groupBy(size.alias("size")).count().collect()}
    counts = spark.createDataFrame([(k, min(PIVOTS, -(-n // tile))) for k, n in rows_of.items()], "size int, wanted int")
    sampled = classes.select("vector", size.alias("size"), F.xxhash64("key").alias("h")).join(F.broadcast(counts), "size")
    firsts = first_n_per_key(sampled, ["size"], ["h", "vector"], PIVOTS)
    order = Window.partitionBy("size").orderBy("h", "vector")  # at most PIVOTS rows of each size
    chosen = firsts.withColumn("place", F.row_number().over(order)).where("place <= wanted")
    vectors_of: dict[int, list[bytes]] = {}
    for row in chosen.orderBy("size", "place").toLocalIterator():
        vectors_of.setdefault(row.size, []).append(row.vector)
    pivots = {k: _units(_matrix(found)) for k, found in vectors_of.items()}
    placed = settle(_with_pivot(classes, pivots), "vector-places")
    groups = placed.groupBy(size.alias("size"), "pivot").agg(F.count("*").alias("rows"), F.max("angle").alias("radius")).collect()
    reach = math.acos(threshold) + 1e-6
    by_size: dict[int, list] = {}
    for group in groups:
        by_size.setdefault(group.size, []).append(group)
    partners = []
    for kind, same_size in by_size.items():
        cosines = np.clip(pivots[kind] @ pivots[kind].T, -1, 1)
        for a in same_size:
            for b in same_size:
                if math.acos(cosines[a.pivot, b.pivot]) - a.radius - b.radius <= reach:
                    partners.append((kind, a.pivot, -(-a.rows // tile), b.pivot, -(-b.rows // tile)))
    if not partners:
        partners = [(0, 0, 1, 0, 1)]
    # At most PIVOTS**2 rows for each size of vectors: bounded, whatever the number of vectors.
    table = F.broadcast(spark.createDataFrame(partners, "size int, pivot int, tiles int, partner int, partner_tiles int"))
    dealt = placed.withColumn("size", size).join(table, ["size", "pivot"])
    dealt = dealt.withColumn("place", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("partner_place", F.explode(F.sequence(F.lit(0), F.col("partner_tiles") - 1)))
    mine, other = F.struct("pivot", "place"), F.struct(F.col("partner").alias("pivot"), F.col("partner_place").alias("place"))
    dealt = dealt.select("size", F.least(mine, other).alias("low"), F.greatest(mine, other).alias("high"), (mine <= other).alias("home"), "id", "n", "vector")

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        return _compare(rows, key[1].as_py() == key[2].as_py(), threshold)

    found = settle(
        dealt.groupBy("size", "low", "high").applyInArrow(compare, "id bigint, n bigint, root bigint"), "vector-links"
    )
    counts = found.groupBy("id").agg(F.sum("n").alias("links"))
    parts = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), "vector-components")
    joined = (
        classes.select("key", "id", "vec_id", "n")
        .join(counts, "id", "left")
        .join(parts, "id", "left")
        .select("key", "vec_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("part"))
    )
    lowest = joined.groupBy("part").agg(F.min("vec_id").alias("found"))
    per_class = joined.join(lowest, "part").select("key", "n_links", "found")
    root = F.coalesce("found", "vec_id")
    return keyed.select("vec_id", "key").join(per_class, "key", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        root.alias("component_id"),
        F.coalesce(F.col("vec_id") == root, F.lit(True)).alias("kept"),
    )
