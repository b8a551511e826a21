"""Near-duplicates, repeated passages, vectors and classifiers against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressroom.llm import minhash, quality, suffix, toxicity, vectors
from pressroom.llm.common import connected_components

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def roots_of(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in links:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    return {n: root(n) for n in nodes}


def test_components(spark):
    random.seed(1)
    links = [(i, i + 1) for i in range(200, 260)] + [(1, n) for n in range(2, 60)] + [(random.randrange(300, 400), random.randrange(300, 400)) for _ in range(70)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = roots_of({n for link in links for n in link}, links)
    assert all(got.get(n, n) == c for n, c in want.items())
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def shingle_set(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def near_groups(docs, size, percent):
    """Component id of every (id, set); rows without an id are left out."""
    nodes = sorted({(i, tuple(sorted(shingle_set(t, size)))) for i, t in docs if i is not None})
    links = []
    for n, (a, x) in enumerate(nodes):
        for b, y in nodes[n + 1 :]:
            both = len({*x} & {*y})
            if both and 100 * both >= percent * (len(x) + len(y) - both):
                links.append(((a, x), (b, y)))
    roots = roots_of(nodes, links)
    return {(i, frozenset(x)): roots[i, x][0] for i, x in nodes}


def near_documents():
    random.seed(11)
    say = lambda n: [f"v{random.randrange(3_000)}" for _ in range(n)]
    docs = [(1, None), (2, ""), (3, " \n "), (4, "one"), (5, "ONE"), (6, "one two"), (7, "long " * 30_000)]
    for group in range(8):
        base = say(random.choice([12, 60, 200]))
        for copy in range(14):
            words = list(base)
            for _ in range(random.randrange(0, len(base) // 10 + 2)):
                words[random.randrange(len(words))] = f"n{random.randrange(10**6)}"
            docs.append((100 * (group + 1) + copy, " ".join(words)))
    docs += [(50, docs[10][1]), (None, docs[10][1]), (101, docs[8][1])]
    return docs


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, size, percent):
    docs = near_documents()
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "'x' AS band", "1 AS kept")
    got = minhash.components(df, size, percent).collect()
    roots = near_groups(docs, size, percent)
    want = []
    for i, text in docs:
        found = shingle_set(text, size)
        root = roots.get((i, found))
        want.append((i, len(found), root, i is None or root == i))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert minhash.components(df.limit(0), size, percent).count() == 0


def test_blocks_of_a_large_band(spark):
    """Blocks find the components that one group finds."""
    docs = [d for d in near_documents() if d[0] is not None and d[0] >= 100][:-1]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    whole = minhash.features(df, 3).where("digest is not null").dropDuplicates(["digest"])
    found = whole.select(F.explode("bands").alias("band"), "digest", "bands", "sketch")
    n = found.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    sets = minhash._sets(df, whole.select("digest", F.col("doc_id").alias("id")), 3)
    members = found.join(n, "band").withColumn("component", F.col("digest"))
    limit = minhash.most_odd_bits(0.85, minhash.SAMPLES, minhash.SKETCH_BITS)
    results = [
        {bytes(r.id): bytes(r.component) for r in connected_components(minhash._across(members, sets, 85, limit, block)).collect()}
        for block in (1_000, 3)
    ]
    assert results[0] == results[1]
    roots = near_groups(docs, 3, 85)
    digests = {i: minhash._digest(minhash.shingles(t, 3)) for i, t in docs}
    group = defaultdict(set)
    for (i, found), root in roots.items():
        if found:
            group[root].add(results[0].get(digests[i], digests[i]))
    assert all(len(names) == 1 for names in group.values()) and len(set.union(*group.values())) == len(group)


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_one_id_on_two_texts(spark, size, percent):
    """Each text is linked by itself; a text that is like nothing stays, whatever else has its id."""
    rng = random.Random(size)
    base = [[f"w{rng.randrange(10_000)}" for _ in range(60)] for _ in range(4)]
    text = lambda n, *tail: " ".join([*base[n], *tail])
    docs = [(5, text(0)), (7, text(0, "x")), (7, text(1)), (9, text(2)), (9, text(2)), (9, text(2, "y")), (4, text(3)), (4, text(3, "z")), (6, text(3, "u"))]
    docs += [(11, ""), (11, None), (12, None), (None, text(0)), (None, None), (9, "")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "'x' AS flag", "1 AS digest", "2 AS again", "3 AS word")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.components(df, size, percent).where("doc_id in (5, 7)").collect())
    assert got == [(5, 5, True), (7, 5, False), (7, 7, True)]
    kept = minhash.drop_near_duplicates(df, size, percent)
    assert kept.columns == df.columns
    rows = kept.collect()
    texts = Counter((r.doc_id, r.text or "") for r in rows)
    assert {k for k in texts if k[0] in (5, 7, 6)} == {(5, text(0)), (7, text(1))}
    assert sum(n for (i, t), n in texts.items() if i == 9 and t) == 1 and texts[9, ""] == 1
    assert sum(n for (i, _), n in texts.items() if i == 4) == 1
    assert texts[11, ""] == 1 and texts[12, ""] == 1 and texts[None, text(0)] == 1 and texts[None, ""] == 1


def test_dropping_keeps_one_of_each_group(spark):
    docs = near_documents()
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    rows = minhash.drop_near_duplicates(df, 3, 85).collect()
    roots = near_groups(docs, 3, 85)
    kept = [(r.doc_id, shingle_set(r.text, 3)) for r in rows if r.doc_id is not None]
    groups = Counter(roots[key] for key in kept if key[1])
    assert set(groups) == {root for (_, found), root in roots.items() if found} and set(groups.values()) == {1}
    assert {i for i, t in docs if not shingle_set(t, 3)} == {r.doc_id for r in rows if not shingle_set(r.text, 3)}
    assert minhash.drop_near_duplicates(df.limit(0), 3, 85).count() == 0


def test_odd_sketch_bound():
    """Pairs at the threshold stay below the bound, far ones are above it."""
    rng = np.random.default_rng(4)
    limit = minhash.most_odd_bits(0.85, minhash.SAMPLES, minhash.SKETCH_BITS)
    sketch = lambda s: minhash.odd_sketch(minhash.minhash(s, minhash.SAMPLES), minhash.SKETCH_BITS)
    for similarity, near in ((0.85, True), (0.3, False)):
        for _ in range(60):
            n = 400
            both = round(similarity * 2 * n / (1 + similarity))
            pool = rng.integers(0, 2**63, 2 * n - both).astype(np.uint64)
            a, b = pool[:n], np.concatenate((pool[:both], pool[n:]))
            odd = int(np.bitwise_count(sketch(a) ^ sketch(b)).sum())
            assert (odd <= limit) == near


def repeats(docs):
    seen, out = {}, []
    order = sorted({(i, (t or "").encode()) for i, t in docs if i is not None})
    for doc, data in order:
        covered = np.zeros(len(data), bool)
        for i in range(len(data) - 99):
            if (w := data[i : i + 100]) in seen:
                covered[i : i + 100] = True
            else:
                seen[w] = doc
        kept = np.frombuffer(data, np.uint8)[~covered].tobytes()
        runs = int(covered[0]) + int((covered[1:] & ~covered[:-1]).sum()) if len(data) else 0
        out.append((doc, len(data), int(covered.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def repeat_documents():
    random.seed(8)
    say = lambda n: "".join(random.choice("abcdefgh é\n") for _ in range(n))
    shared = [say(n) for n in (99, 100, 101, 250, 700)]
    docs = [(1, None), (2, ""), (3, "z" * 5_000), (4, "z" * 99), (5, "ab" * 400), (6, "é" * 300), (7, say(3_000))]
    for i in range(40):
        parts = [say(random.choice([0, 5, 80, 300]))]
        for _ in range(random.choice([0, 1, 2])):
            piece = random.choice(shared)
            cut = random.choice([0, 0, 20])
            parts += [piece[cut:], say(random.choice([0, 30, 200]))]
        docs.append((10 + i, "".join(parts)))
    return docs + [(60, shared[4] + shared[3] + shared[4])]


@pytest.mark.parametrize("hot, merge_bytes", [(suffix.HOT_LEAST, suffix.MERGE_BYTES), (3, 2_000)])
def test_repeated_passages(spark, monkeypatch, hot, merge_bytes):
    monkeypatch.setattr(suffix, "HOT_LEAST", hot)
    docs = repeat_documents()
    df = spark.createDataFrame(docs + [(None, docs[6][1]), (20, docs[17][1])] if docs[17][0] == 20 else docs, "doc_id bigint, text string")
    df = df.selectExpr("*", "1 AS version", "'x' AS spans")
    got = suffix.remove_repeats(df).collect()
    assert len(got) == df.count()
    named = [tuple(r)[:5] for r in got if r.doc_id is not None]
    assert sorted(set(named)) == repeats(docs)
    assert all(r.n_removed == 0 for r in got if r.doc_id is None)
    assert suffix.remove_repeats(df.limit(0)).count() == 0


def test_one_text_that_repeats_a_line_very_often(spark, monkeypatch):
    """An anchor thousands of times in one text, between differing surroundings."""
    monkeypatch.setattr(suffix, "HOT_LEAST", 500)
    rng = random.Random(12)
    line = "".join(rng.choice("abcdefgh ") for _ in range(110))
    texts = ["".join(f"{rng.randrange(10**9)} {line} {rng.randrange(10**6)}\n" for _ in range(n)) for n in (4_000, 30)]
    docs = [(1, texts[0]), (2, texts[1]), (3, "x" + line)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = sorted(tuple(r)[:5] for r in suffix.remove_repeats(df).collect())
    assert got == repeats(docs)


def test_merged_transforms_equal_a_full_sort():
    random.seed(6)
    bodies = ["".join(random.choice("ab") for _ in range(random.choice([100, 120, 160]))).encode() for _ in range(24)]
    bodies += [bodies[0][:110], b"x" * 130, b"x" * 115]
    windows = np.array([len(b) - 99 for b in bodies])
    record, offset, interval = suffix.repeated_windows(bodies, windows)
    text = [bodies[r][o : o + 100] for r, o in zip(record.tolist(), offset.tolist())]
    assert len(text) == windows.sum() and text == sorted(text)
    assert all((a == b) == (i == j) for a, b, i, j in zip(text, text[1:], interval.tolist(), interval[1:].tolist()))
    some = suffix.repeated_windows(bodies, windows, singles=False)
    many = Counter(text)
    assert sorted((r, o) for r, o, t in zip(record.tolist(), offset.tolist(), text) if many[t] > 1) == sorted(zip(some[0].tolist(), some[1].tolist()))
    places = list(zip(*(x.tolist() for x in some)))
    assert all((bodies[r][o : o + 100] == bodies[q][p : p + 100]) == (i == j) for (r, o, i), (q, p, j) in zip(places, places[1:]))


def test_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(30, 8))
    rows = [(i, (base[i % 30] + 0.25 * rng.normal(size=8)).tolist()) for i in range(400)]
    rows += [(500, [0.0] * 8), (501, None), (502, []), (503, [float("nan")] * 8), (504, [1.0, None] + [0.0] * 6), (505, [float("inf")] + [0.0] * 7)]
    rows += [(506, rows[3][1]), (507, rows[3][1]), (508, [2 * x for x in rows[3][1]]), (509, rows[3][1][:4]), (510, [1e300] * 8), (511, [1e-300] * 8)]
    rows += [(None, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "1 AS key", "2 AS n")
    good = [(i, np.array(v) / np.abs(v).max()) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = [
        (a, b) for k, (a, x) in enumerate(good) for b, y in good[k + 1 :]
        if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9
    ]
    roots = roots_of([i for i, _ in rows if i is not None], links)
    count = {i: sum(i in link for link in links) for i in roots}
    for tile in (vectors.TILE, 7):
        got = vectors.near_duplicates(df, tile=tile).collect()
        assert len(got) == len(rows)
        for row in got:
            if row.vec_id is None:
                assert (row.n_links, row.component_id, row.kept) == (0, None, True)
            else:
                assert (row.n_links, row.component_id, row.kept) == (count[row.vec_id], roots[row.vec_id], roots[row.vec_id] == row.vec_id)
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_one_id_on_two_vectors(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (7, [0.99, 0.01, 0.0]), (7, [0.0, 0.0, 1.0]), (9, [0.0, 1.0, 0.0]), (9, [0.0, 1.0, 0.0]), (4, [0.0, 0.99, 0.05])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect())
    assert got == [(1, 1, 1, True), (4, 2, 4, True), (7, 0, 7, True), (7, 1, 1, False), (9, 2, 4, False), (9, 2, 4, False)]


def test_many_sizes_of_vectors(spark):
    rows = [(100 * n + i, [1.0 + i * 1e-3] + [0.5] * n) for n in range(1, 60) for i in range(2)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {r.vec_id: r.component_id for r in vectors.near_duplicates(df).collect()}
    assert got == {i: i - i % 100 for i, _ in rows}


def test_quantisation_bound():
    rng = np.random.default_rng(7)
    tile = vectors._Tile(np.arange(200), np.ones(200, int), rng.normal(size=(200, 64)))
    exact = tile.unit @ tile.unit.T
    near = tile.scale * tile.quantised @ (tile.scale * tile.quantised).T
    bound = tile.error[:, None] + (1 + tile.error[:, None]) * tile.error[None, :]
    assert (np.abs(exact - near) <= bound + 1e-9).all()


def labelled(spark, folder="/root/testdata/sf0.01"):
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


def test_toxicity_held_out(spark):
    docs, labels = labelled(spark)
    got = toxicity.report(docs, labels)
    assert got.count() == docs.count()
    rows = got.join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.toxic for r in rows)
    caught = [r for r in rows if r.predicted]
    assert right >= 0.93 * len(rows) and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.toxic for r in caught) >= 0.9 * len(caught) and len(caught) >= 0.6 * sum(r.toxic for r in rows)


def test_classifiers_on_odd_input(spark):
    docs = spark.createDataFrame(
        [(1, None), (2, ""), (3, "You idiot! stupid stupid loser"), (4, "fine words"), (None, "x"), (4, "fine words"), (5, "word " * 20_000)],
        "doc_id bigint, text string",
    ).selectExpr("*", "'x' AS features", "2 AS score", "'en' AS lang")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    some = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1), (9, 0, 1)], "doc_id bigint, quality int, toxic int")
    for labels in (none, some):
        for module in (toxicity, quality):
            rows = module.report(docs, labels).collect()
            assert len(rows) == 7 and all(0 <= r.score <= 1 for r in rows)
            assert module.report(docs.limit(0), labels).count() == 0
    scores = {r.doc_id: r.score for r in toxicity.report(docs, none).collect()}
    assert scores[3] >= 0.7 > scores[4]


def test_obfuscation_and_nearness():
    names = toxicity.FEATURES
    plain = dict(zip(names, toxicity.measure("you are an idiot", {"idiot": 2.0}, {})))
    masked = dict(zip(names, toxicity.measure("an 1d10t here", {"idiot": 2.0}, {})))
    assert plain["hits"] == 1 and plain["near_share"] == 1 and masked["hits"] == 0 and masked["disguised_hits"] == 1
    assert toxicity.measure("", {}, {}) == [0.0] * len(names)
    friendly = dict(zip(names, toxicity.measure("you and your friends are fine", {"idiot": 2.0}, {})))
    assert friendly["second_person"] == 2 / 6 and friendly["hits"] == 0
    long = dict(zip(names, toxicity.measure("an " + "1d10t" * 30 + " here", {"idiot" * 30: 2.0}, {})))
    assert long["disguised_hits"] == 1 and long["disguised_rate"] > 0


def test_shouted_words_in_long_text():
    """Capitals count in every text, not only where they outnumber the words."""
    text = "calm words here " * 200 + "YOU IDIOT"
    found = dict(zip(toxicity.FEATURES, toxicity.measure(text, {"idiot": 2.0}, {})))
    assert found["shouted"] == 2 / 602


@pytest.mark.parametrize("size", [50, 600, 6_000])
def test_nearness_equals_the_double_loop(size):
    """At every size, also above 10,000 pairs of a hit and a second person."""
    rng = random.Random(size)
    found = rng.choices(["idiot", "you", "sie", "word", "other"], [1, 1, 1, 12, 12], k=size)
    at = [i for i, w in enumerate(found) if w == "idiot"]
    persons = [i for i, w in enumerate(found) if w in ("you", "sie")]
    near = sum(any(abs(i - p) <= toxicity.NEAR for p in persons) for i in at)
    got = dict(zip(toxicity.FEATURES, toxicity.measure(" ".join(found), {"idiot": 2.0}, {})))
    assert got["hits"] == len(at) and got["near_share"] == near / max(1, len(at))
    far = "idiot " * 100 + "word " * 10 + "you " * 100
    assert toxicity.measure(far, {"idiot": 2.0}, {})[toxicity.FEATURES.index("near_share")] == 0


def test_quality_held_out(spark):
    docs, labels = labelled(spark)
    rows = quality.report(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)
