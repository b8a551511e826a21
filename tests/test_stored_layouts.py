"""Stored layouts: keyed upserts, the catalogue with its intake index, pruned look-ups, merged counts."""

from __future__ import annotations

import os
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pressroom import schemas, session
from pressroom.functions.text import serving_words
from pressroom.operators import catalogue, dedupe, topics
from pressroom.operators.wordcounts import count_words
from pressroom.plans.ingest import ingest, ingest_into
from pressroom.sources import tables
from pressroom.sources.catalogue_store import CatalogueStore
from pressroom.sources.keyed_table import KeyedTable


def files(folder):
    return {str(p.relative_to(folder)) for p in folder.rglob("part-*.parquet")}


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "k", buckets=16)
    assert not table.exists()
    table.upsert(spark.range(500).select(F.col("id").alias("k"), F.lit("old").alias("v"), F.lit(1).alias("seq")), "seq")
    before = files(tmp_path / "t")
    changes = [(3, "new", 2), (3, "newest", 3), (7, "stale", 0), (9999, "added", 1), (None, "null", 1)]
    table.upsert(spark.createDataFrame(changes, "k bigint, v string, seq int"), "seq")
    after = files(tmp_path / "t")
    touched = {name.split("/")[0] for name in after - before}
    hit = spark.createDataFrame(changes, "k bigint, v string, seq int").select(F.pmod(F.xxhash64("k"), F.lit(16)).alias("b")).distinct()
    assert touched == {f"_bucket={r.b}" for r in hit.collect()} and len(touched) < 6
    assert {n for n in before if n.split("/")[0] not in touched} <= after, "untouched files keep their names"
    got = {r.k: r.v for r in table.read().collect()}
    assert len(got) == 502 and (got[3], got[7], got[9999], got[None], got[8]) == ("newest", "old", "added", "null", "old")
    found = table.read_keys(spark.createDataFrame([(3,), (4,), (77777,)], "k bigint"))
    assert {r.k: r.v for r in found.collect()} == {3: "newest", 4: "old"}
    table.upsert(spark.createDataFrame([], "k bigint, v string, seq int"), "seq")
    assert files(tmp_path / "t") == after


def article(number, title, content, day=1):
    return (f"BB-{number}", title, "", content, None, "", "", "published", "", "", "")


def rows_read(frame):
    """Rows that the Parquet scan of a collected frame has handed on."""
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return [leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()) if "Scan" in leaves.apply(i).nodeName()]


def test_point_lookup_skips_row_groups(spark, tmp_path):
    path = str(tmp_path / "articles")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark._jsc.hadoopConfiguration().setInt("parquet.block.size", 64 * 1024)
    try:
        numbers = list(range(20_000))
        random.Random(1).shuffle(numbers)
        rows = spark.range(20_000).select(
            F.concat(F.lit("BB-"), F.element_at(F.array(*[F.lit(0)]), 1) + F.col("id")).alias("article_id"),
            F.repeat(F.md5(F.col("id").cast("string")), 4).alias("title"),
        )
        full = rows.select(*[F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.ARTICLES])
        tables.append_articles(full.repartition(4), path)
        for key, there in (("BB-777", 1), ("BB-777x", 0)):
            found = catalogue.where_equal(tables.read_articles(spark, path), article_id=key)
            assert "EqualTo(article_id" in found._jdf.queryExecution().executedPlan().toString()
            assert rows_read(found)[0] < 6_000 and found.count() == there
        prefix = tables.read_articles(spark, path).filter(F.startswith("article_id", F.lit("BB-77")))
        assert "StringStartsWith(article_id" in prefix._jdf.queryExecution().executedPlan().toString()
        assert rows_read(prefix)[0] < 8_000
        # An id within the range of ids, but not stored: the Bloom filter leaves nothing to read.
        absent = catalogue.where_equal(tables.read_articles(spark, path), article_id="BB-15000a")
        assert sum(rows_read(absent)) == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark._jsc.hadoopConfiguration().unset("parquet.block.size")


def page(title, *paragraphs):
    inner = "".join(f"<p>{p}</p>" for p in paragraphs)
    return f"<h1>{title}</h1><div class='detail-content afcbc-body'>{inner}</div>"


def crawled(spark, seed, first):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choices(words, k=rng.randint(3, 25))) for _ in range(25)]
    rows = [(first + i, f"https://nld.com.vn/{first + i}", page(rng.choice(["Same", f"T{first + i}", f"T{i}"]), text)) for i, text in enumerate(texts + texts[:6])]
    return spark.createDataFrame(rows, schemas.PAGES)


@pytest.mark.parametrize("window", [None, 10])
def test_incremental_intake_equals_rebuild(spark, tmp_path, window):
    model = topics.fit(spark.createDataFrame([("a", "w1 w2 w3 wxyz"), ("b", "w30 w31 abcd")], "label string, body string"), "body", "label")
    stamp = F.lit("2025-01-01 00:00:00").cast("timestamp")
    store = CatalogueStore(spark, str(tmp_path / "store"))
    everything = spark.createDataFrame([], schemas.ARTICLES)
    for number in range(3):
        pages = crawled(spark, number % 2, 100 * number)  # the third run repeats the texts of the first
        want = ingest(pages, everything, model, stamp, window=window).collect()
        got = ingest_into(store, pages, f"run-{number}", model, stamp, window=window)
        assert sorted(map(str, got.collect())) == sorted(map(str, want))
        assert (len(want) == 0) == (number == 2 and window is None)
        known = {r.article_id for r in everything.collect()}
        assert not known & {r.article_id for r in want}, "no new id is stored"
        everything = spark.createDataFrame([*everything.collect(), *want], schemas.ARTICLES)
        # The next run does without stored articles: they are read by nobody.
        (tmp_path / "store" / "articles").rename(tmp_path / f"away-{number}")
        (tmp_path / "store" / "articles").mkdir()
    for number in range(3):
        for folder in (tmp_path / f"away-{number}").glob("batch=*"):
            folder.rename(tmp_path / "store" / "articles" / folder.name)
    assert sorted(map(str, store.articles().collect())) == sorted(map(str, everything.collect()))
    assert store.keys().count() == store.words().count() == everything.count()
    again = ingest_into(store, crawled(spark, 0, 0), "run-0", model, stamp, window=window)
    assert again.count() == store.batch("run-0").count() and store.keys().count() == everything.count()


def test_unfinished_batch_does_not_exist(spark, tmp_path):
    store = CatalogueStore(spark, str(tmp_path / "store"))
    assert store.keys().count() == 0 and store.articles().columns == schemas.ARTICLES.names
    rows = spark.createDataFrame([article(1, "one", "some words here")], schemas.ARTICLES)
    store.append(rows, "good")
    rows.select("article_id", "title", "date_posted").write.parquet(str(tmp_path / "store" / "keys" / "batch=bad"))
    assert store.keys().count() == 1 and store.has("good") and not store.has("bad")


def test_merged_counts_equal_one_fit(spark, tmp_path):
    rng = random.Random(5)
    words = [f"word{i}" for i in range(50)] + ["của", "và", "ab", "..."]
    rows = [(i, rng.choice(["x", "y", "z", None]), " ".join(rng.choices(words, k=rng.randrange(30)))) for i in range(200)]
    rows.append((500, "only-late", "word1 quitenew"))
    docs = spark.createDataFrame(rows, "id bigint, label string, body string")
    for path, cut in (("a", 1), ("b", 30)):
        folder = str(tmp_path / path)
        for batch, part in (("1", docs.filter("id < 60")), ("2", docs.filter("id between 60 and 400")), ("3", docs.filter("id > 400")), ("2", docs.filter("id between 60 and 400"))):
            topics.add_to_counts(part, "body", "label", folder, batch)
        merged, whole = topics.merged_model(spark, folder, cut), topics.fit(docs, "body", "label", cut)
        assert (merged.labels, merged.n_docs, merged.n_words, merged.vocabulary_size) == (whole.labels, whole.n_docs, whole.n_words, whole.vocabulary_size)
        assert sorted(map(tuple, merged.words.select("term", "total", "n").collect())) == sorted(map(tuple, whole.words.select("term", "total", "n").collect()))


def test_words_are_counted_in_their_row(spark):
    rows = [(1, "aa bb aa"), (2, ""), (3, None), (4, "été ÉTÉ x aa"), (5, "zz " * 5000)]
    docs = spark.createDataFrame(rows, "id bigint, body string").withColumn("terms_", F.lit(1))
    counted = count_words(docs, ["id"], serving_words(F.col("body")))
    got = {r.id: dict(zip(r.terms, r.counts)) for r in counted.collect()}
    assert got == {i: dict(Counter(re.findall(r"\w{2,}", (t or "").lower()))) for i, t in rows}
    nulls = count_words(docs, ["id"], F.when(F.col("id") > 1, F.split("body", " ")))
    assert {r.id: len(r.terms) for r in nulls.collect()}[1] == 0


@pytest.mark.parametrize("n_new, n_stored", [(20, 150), (150, 20)])
def test_either_side_may_be_the_index(spark, n_new, n_stored):
    rng = random.Random(n_new)
    words = [f"w{i}" for i in range(30)]
    text = lambda: " ".join(rng.choices(words, k=rng.randint(1, 12)))
    new = [(i, text()) for i in range(n_new)] + [(1000, ""), (1001, "unknown words"), (1002, None)]
    stored = [(f"s{i}", text()) for i in range(n_stored)]
    left, right = spark.createDataFrame(new, "id bigint, body string"), spark.createDataFrame(stored, "name string, body string")
    flags = dedupe.flag_near_duplicates(left, right, "id", "body", stored_key="name", index_pairs=60)
    bags = [Counter(t.split()) for _, t in stored]
    known = set().union(*bags)

    def near(text):
        bag = {w: n for w, n in Counter(re.findall(r"\w{2,}", text or "")).items() if w in known}
        norm = sum(n * n for n in bag.values())
        return any(
            25 * sum(n * other[w] for w, n in bag.items()) ** 2 >= 16 * norm * sum(n * n for n in other.values()) > 0 for other in bags
        )

    assert {r.id: r.near_duplicate for r in flags.collect()} == {i: near(t) for i, t in new}


def test_index_over_sliced_arrays():
    terms = pa.array([["x"], ["a", "b"], [], ["b", "c"]])
    counts = pa.array([[9], [1, 2], [], [2, 1]], pa.list_(pa.int32()))
    index = dedupe.WordIndex(terms.slice(1), counts.slice(1))
    hits = next(index.similar(terms.slice(1, 2), counts.slice(1, 2), Fraction(4, 5), whole=True))
    assert hits.tolist() == [[True, False, True], [False, False, False]]


def _jobs(spark, action):
    context = spark.sparkContext
    group = f"jobs-{random.random()}"
    context.setJobGroup(group, "counted")
    try:
        action()
        return len(context.statusTracker().getJobIdsForGroup(group))
    finally:
        context._jsc.clearJobGroup()


def test_near_duplicate_jobs_do_not_grow_with_the_stored_words(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(5, 20)))) for i in range(400)]
    docs = spark.createDataFrame(rows, "id bigint, body string")
    new, stored = docs.where("id % 2 = 1"), docs.where("id % 2 = 0")
    # Some 2,400 stored pairs: 160 blocks of 15 pairs.
    assert _jobs(spark, lambda: dedupe.flag_near_duplicates(new, stored, "id", "body", index_pairs=30).collect()) < 60


def test_tiles_match_brute_force(spark, monkeypatch):
    """Many tiles, few cells, words of very different frequency, repeated rows, a cosine at the threshold."""
    monkeypatch.setattr(dedupe, "TILE_PAIRS", 2_000)
    monkeypatch.setattr(dedupe, "WITNESSES", 3)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    shares = [1 / (i + 1) for i in range(300)]
    text = lambda: " ".join(rng.choices(words, shares, k=rng.randint(1, 40)))
    stored = [text() for _ in range(200)] + ["xx", "", "yy yy yy"]
    new = [(i, text()) for i in range(200)] + [(500, "xx xx xx xx zz zz zz"), (501, "xx xx xx xx yy yy yy"), (502, "xx xx xx yy yy yy yy")]
    new += [(503, "xx xx xx yy yy yy"), (504, "never said"), (505, None), (None, "xx"), (None, "nothing"), (7, new[7][1])]
    frame = spark.createDataFrame(new, "id bigint, body string").repartition(3)
    old = spark.createDataFrame(list(enumerate(stored)), "id bigint, body string")
    flags = dedupe.flag_near_duplicates(frame, old, "id", "body", index_pairs=50)
    bags = [Counter(t.split()) for t in stored]
    known = set().union(*bags)

    def near(text):
        bag = {w: n for w, n in Counter((text or "").split()).items() if w in known}
        norm = sum(n * n for n in bag.values())
        return any(
            25 * sum(n * other[w] for w, n in bag.items()) ** 2 >= 16 * norm * sum(n * n for n in other.values()) > 0 for other in bags
        )

    want = Counter((i, near(t)) for i, t in new)
    assert Counter((r.id, r.near_duplicate) for r in flags.collect()) == want
    assert want[(501, True)] and want[(503, False)] and 20 < sum(hit for _, hit in want.elements()) < 190


def test_tiles_are_shared_out(spark, monkeypatch):
    """The rows of 0.5 GB make enough tiles for all cores, those of 6 GB no more than their pairs ask for; tiles stay apart in their tasks."""
    some, more = ((100_000 * i, 10_000_000 * i) for i in (1, 12)), ((25_000 * i, 8_000_000 * i) for i in (1, 12))
    (small, large) = (dedupe._chunks(new, old) for new, old in zip(some, more))
    assert 24 <= small[0] * small[1] <= 36
    assert 720 <= large[0] * large[1] <= 800  # 3.6e11 pairs
    assert dedupe._chunks((100, 1_000), (100, 1_000)) == (1, 1) == dedupe._chunks((0, 0), (5, 9))
    monkeypatch.setattr(dedupe, "LEAST_TILE_PAIRS", 4)
    rows = [(i, [i, 7], [1, 1]) for i in range(40)]
    bags = spark.createDataFrame(rows, "_row bigint, hashes array<bigint>, counts array<int>")
    tiles = dedupe._in_tiles(bags, bags.where("_row % 2 = 0"), Fraction(4, 5))
    assert "REPARTITION_BY_NUM" in tiles._jdf.queryExecution().toString()
    assert sorted(r["_row"] for r in tiles.collect()) == list(range(0, 40, 2))


def test_chunks_are_written_once_for_all_tiles(spark, monkeypatch):
    """More tiles do not write more: every row stands in one chunk, and a tile reads its two chunks where they are."""
    monkeypatch.setattr(dedupe, "LEAST_TILE_PAIRS", 4)
    rows = [(i, [i, 7], [1, 1]) for i in range(40)]
    bags = spark.createDataFrame(rows, "_row bigint, hashes array<bigint>, counts array<int>")
    packs = [pa.ipc.open_stream(r.new).read_all() for r in dedupe._packed(bags, 6, "new").collect()]
    assert 1 < len(packs) <= 6
    assert sorted(pa.concat_tables(packs).to_pylist(), key=lambda r: r["_row"]) == [dict(zip(bags.columns, r)) for r in rows]
    tiles = dedupe._in_tiles(bags, bags.where("_row % 2 = 0"), Fraction(4, 5))
    plan = tiles._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan
    assert not dedupe._in_tiles(bags.limit(0), bags, Fraction(4, 5)).collect()


def test_intermediate_tables_go_when_nothing_reads_them_again(spark, monkeypatch):
    """Hashes are not stored beside the words, words go after the tiles, and a tile worked on in parts finds the same."""
    monkeypatch.setattr(dedupe, "LEAST_TILE_PAIRS", 4)
    monkeypatch.setattr(dedupe, "TILE_WORDS_AT_ONCE", 7)
    monkeypatch.setattr(dedupe, "WITNESSES", 1)
    rows = [(i, f"w{i} w{i} w{i + 1} " + "aa " * (i % 3)) for i in range(40)]
    docs = spark.createDataFrame(rows, "id bigint, body string")
    made, kept = [], session.shared_path
    monkeypatch.setattr(session, "shared_path", lambda spark, name: made.append(kept(spark, name)) or made[-1])
    with session.scratch(spark):
        flags = dedupe.flag_near_duplicates(docs, docs.where("id % 2 = 0"), "id", "body", index_pairs=10)
        left = {name.rsplit("/", 1)[-1][:-33] for name in made if os.path.exists(name.removeprefix("file:"))}
        got = {r.id for r in flags.collect() if r.near_duplicate}
    assert left == {"first-look", "near"}
    bags = {i: Counter(t.split()) for i, t in rows}
    known = set().union(*(bags[i] for i in range(0, 40, 2)))

    def near(mine, other):
        square = sum(n * n for w, n in mine.items() if w in known)
        return 25 * sum(n * other[w] for w, n in mine.items()) ** 2 >= 16 * square * sum(n * n for n in other.values())

    assert got == {i for i in bags if any(near(bags[i], bags[j]) for j in range(0, 40, 2))}
    lists = pa.array([[1] * n for n in (0, 3, 9, 2, 2, 0, 4)])
    assert [(p.start, p.stop) for p in dedupe._parts(lists.slice(1), 7)] == [(0, 1), (1, 2), (2, 5), (5, 6)]


def test_shuffle_files_of_settled_tables_go(spark, tmp_path):
    before = spark.conf.get(session._SHUFFLE_CLEANUP, None)
    table = session.settle(spark.range(9).repartition(3, "id"), "dealt", codec="zstd")
    assert spark.conf.get(session._SHUFFLE_CLEANUP, None) == before
    assert sorted(r.id for r in table.collect()) == list(range(9))
    path = table.inputFiles()[0].removeprefix("file:").lstrip("/").rsplit("/", 1)[0]
    assert all(".zstd." in name for name in os.listdir(f"/{path}") if name.startswith("part-"))
    session.discard(table, spark.range(1))
    assert not os.path.exists(f"/{path}")


def test_tile_outlines_bound_the_cosine():
    rng = np.random.default_rng(3)
    docs = [np.unique(np.minimum(rng.zipf(1.3, rng.integers(1, 400)), 5_000)) for _ in range(300)]
    lists = pa.array([d.tolist() for d in docs], pa.list_(pa.int64()))
    counts = pa.array([rng.integers(1, 9, len(d)).tolist() for d in docs], pa.list_(pa.int32()))
    words = pa.array(np.unique(np.concatenate(docs[150:])))
    index = dedupe.TileIndex(words, lists.slice(0, 150), counts.slice(0, 150))
    n = counts.slice(150).flatten().to_numpy().astype(float)
    rows = np.repeat(np.arange(150), [len(d) for d in docs[150:]])
    place = np.searchsorted(words.to_numpy(), np.concatenate(docs[150:]))
    squares = np.bincount(rows, n * n)
    dense = np.zeros((300, 5_001))
    for i, d in enumerate(docs):
        dense[i, d] = counts[i].as_py()
    dense /= np.linalg.norm(dense, axis=1)[:, None]
    cosine = dense[150:] @ dense[:150].T
    bound = index.outline(rows, place, n, squares) @ index.outlines.T
    assert (bound >= cosine - dedupe.ROUNDING).all()
    for threshold in (Fraction(1, 2), Fraction(4, 5), Fraction(19, 20)):
        assert index.reached(rows, place, n, squares, threshold).tolist() == (cosine >= float(threshold)).any(axis=1).tolist()


def test_first_look_leaves_unknown_words_out(spark):
    """Markup words that no stored row has do not keep a copy of a stored text from being found at first sight."""
    bags = [(1, ["aa", "bb"], [3, 1]), (2, ["cc"], [2]), (3, ["dd", "aa"], [1, 5])]
    schema = "_row bigint, terms array<string>, counts array<int>"
    stored = dedupe._hashed(spark.createDataFrame(bags, schema))
    new = [(1, ["aa", "bb", "class"], [3, 1, 40]), (2, ["dd"], [1]), (3, [], []), (4, ["class"], [7])]
    mine = dedupe._hashed(spark.createDataFrame(new, schema)).withColumn("id", F.col("_row") + 10)
    vocabulary = stored.select(F.explode("hashes").alias("hash")).distinct()
    common = pa.array([r.hash for r in vocabulary.collect()], pa.int64())
    bits = dedupe._vocabulary_bits(vocabulary)
    assert np.unpackbits(bits).sum() == 4
    looked = dedupe._first_look(mine, "id", common, dedupe._witnesses(stored, common), bits, Fraction(4, 5)).collect()
    assert {r.id: (r.sure, len(r.hashes)) for r in looked} == {11: (True, 0), 12: (False, 1), 13: (False, 0), 14: (False, 1)}
