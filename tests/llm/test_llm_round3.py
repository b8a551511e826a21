"""Token id files, phrase mining and lexical search against brute force."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pressroom.llm import automata, decontaminate, idfiles, perfect_hash, phrases, search

FILE = public_tokenizers.path("word_bpe_49k.json")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


# Minimal perfect hash and token id files


def test_perfect_hash():
    keys = [idfiles.key_words(i, 0) for i in range(30_000)]
    high, low = np.array(keys, np.uint64).T.copy()
    data = perfect_hash.packed(high, low, {"value": np.arange(30_000)})
    index = perfect_hash.Index(data)
    slots = index.find(high, low)
    assert sorted(slots) == list(range(30_000))
    assert (index.values["value"][slots] == np.arange(30_000)).all()
    others = np.array([idfiles.key_words(i, 0) for i in range(30_000, 60_000)], np.uint64).T.copy()
    assert (index.find(*others) < 0).mean() > 0.999
    empty = perfect_hash.Index(perfect_hash.packed(high[:0], low[:0], {}))
    assert (empty.find(high[:5], low[:5]) == -1).all()
    with pytest.raises(ValueError):
        perfect_hash.packed(high[[1, 1]], low[[1, 1]], {})


ODD = [
    "", "   \t\n ", "Hello, World! It's 2024; don't", "ÀÉÎ straße ΣΑΣ İstanbul ﬁn", "J̌arek étude Á Ǩ", "日本語 テキスト　全角",
    "a b c\x0bd\x0ce\x85f\x1cg", "<|endoftext|> x<|startoftext|>y", "🙂👍🏽 ok​zero", "'S 'T THE'LL'VE", "ab" * 3000, "x\x00y \x7f\x1b",
    "ÅNGSTRÖM Å Ω Ǆ", "Ｆｕｌｌ １２３ ½ ²", "ക്ഷ नमस्ते العربية עִבְרִית",
]


def test_words_are_encoded_as_in_the_whole_text():
    random.seed(3)
    texts = ODD + [" ".join(random.choices(ODD, k=4)) + random.choice("\n\t\r ").join(random.choices(ODD, k=3)) for _ in range(40)]
    own, whole = idfiles.Encoder(FILE), idfiles.Encoder(FILE, by_words=False)
    assert own.by_words and own.encode(texts) == whole.encode(texts)
    assert own.encode(texts[::-1]) == whole.encode(texts[::-1])
    other = idfiles.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not other.by_words and other.encode(["a  b"]) == [np.array(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode("a  b").ids, "<u2").tobytes()]


def brute_ids(rows):
    """(key, copy) -> (start, ids, crc32) by the library alone."""
    tokenizer = Tokenizer.from_file(FILE)
    tokenizer.encode_special_tokens = True
    out, at, seen = {}, 0, Counter()
    for key, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        out[key, seen[key]] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        seen[key] += 1
        at += len(ids)
    return out


def test_id_files(spark, tmp_path):
    random.seed(5)
    rows = [(i, random.choice(ODD) + f" word{i} " * random.randrange(40)) for i in random.sample(range(10_000), 400)]
    rows += [(None, "no id"), (7, None), (20_000, "long " * 200_000)]
    # Clashing names of further columns are not read.
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("shard", F.lit("x")).withColumn("key", F.lit(1))
    keys = idfiles.write(docs.repartition(5), str(tmp_path / "ids"), FILE, 2)
    got = {(r.key, r.copy): (r.start, r.n_tokens, r.ids_crc32) for r in idfiles.read(spark, str(tmp_path / "ids"), keys).collect()}
    ordered = sorted(rows, key=lambda row: (row[0] is not None, row[0] or 0))
    assert got == brute_ids(ordered)
    reader = idfiles.IdFiles(str(tmp_path / "ids"))
    tokenizer = Tokenizer.from_file(FILE)
    for key, text in rows[:20]:
        assert reader.get(key).tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
    assert reader.get(123_456_789) is None and reader.get(rows[0][0], 1) is None
    unknown = spark.createDataFrame([(123_456_789, 0)], "key bigint, copy bigint")
    assert idfiles.lookup(spark, str(tmp_path / "ids"), unknown).first().shard is None
    assert idfiles.read(spark, str(tmp_path / "ids"), unknown).count() == 0


def test_id_files_with_repeated_keys(spark, tmp_path):
    rows = [(1, "a"), (1, "b"), (1, "a"), (None, "x"), (None, "y"), (2, "c")]
    docs = spark.createDataFrame(rows * 3, "doc_id bigint, text string").repartition(4)
    folder = f"file://{tmp_path}/again"
    keys = idfiles.write(docs, folder, FILE, 2)
    assert sorted((r.key or 0, r.copy) for r in keys.collect()) == sorted((k or 0, c) for k, n in ((1, 9), (None, 6), (2, 3)) for c in range(n))
    got = idfiles.read(spark, folder, keys).collect()
    assert len(got) == 18 and sorted(r.start for r in got) == list(range(0, 36, 2))
    by_key = defaultdict(list)
    for r in sorted(got, key=lambda r: r.start):
        by_key[r.key].append(r.copy)
    assert list(by_key) == [None, 1, 2] and all(copies == list(range(len(copies))) for copies in by_key.values())


def test_id_files_of_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id string, text string")
    keys = idfiles.write(docs, str(tmp_path / "none"), FILE, 2)
    assert keys.count() == 0 and idfiles.read(spark, str(tmp_path / "none"), keys).count() == 0
    assert idfiles.IdFiles(str(tmp_path / "none")).get("a") is None


# Automata and phrases


def runs_of(lists):
    return Counter(tuple(words[i : i + 4]) for words in lists for i in range(len(words)))


@pytest.mark.parametrize("vocabulary", [5, 300, 100_000])
def test_automaton(vocabulary):
    random.seed(vocabulary)
    names = [f"w{i}ü".encode() for i in range(vocabulary)]
    lists = [[random.choice(names) for _ in range(random.randrange(30))] for _ in range(300)]
    if vocabulary > 70_000:
        lists.append(names)
    want = runs_of(lists)
    parts = [automata.Windows.of([t for words in part for t in [*words, b"."]], b".") for part in (lists[:100], lists[100:], [])]
    windows = automata.Windows.union(parts)
    got = {windows.words(i): int(windows.weights[i]) for i in range(len(windows))}
    assert got == want and list(got) == sorted(got)
    built = automata.Automaton.unpacked(automata.Automaton.build(windows).packed())
    again = built.unfold()
    assert {again.words(i): int(again.weights[i]) for i in range(len(again))} == want
    asked = [tuple(random.choices(names, k=random.randrange(1, 5))) for _ in range(300)] + random.sample(sorted(want), 50) + [(b"none",)]
    asked += [words[: random.randrange(1, len(words) + 1)] for words in random.sample(sorted(want), 50)]
    found = built.compose(asked)
    assert found.tolist() == [sum(n for run, n in want.items() if run[: len(words)] == words) for words in asked]
    if vocabulary == 5:
        assert sum(len(first) - 1 for first in built.first) < sum(len({run[:i] for run in want}) for i in range(4))
    for words in asked[:40]:
        low, high = windows.span(words)
        assert int(windows.weights[low:high].sum()) == sum(n for run, n in want.items() if run[: len(words)] == words)
    none = automata.Automaton.build(automata.Windows.union([]))
    assert none.compose([(b"x",)]).tolist() == [0] and len(none.unfold()) == 0


def test_phrase_words_stay_in_arrow():
    """Words and borders of a unit are one Arrow array, the same as cut text by text; equal pairs of keys keep no order."""
    texts = ["", " \t", "A b.C", "x,,\r\n Y\tü É!", ".", "end", "a\u00a0b\x00c ; \x0bd", "z " * 3]
    words = phrases.tokens(texts)
    plain = [w for text in texts for w in re.sub(r"[.,;:!?\x0a-\x0d]", " . ", text.translate(LOWER) + " .").replace("\t", " ").split(" ") if w]
    assert isinstance(words, pa.Array) and [w.decode() for w in words.to_pylist()] == plain
    one, other = (automata.Windows.of(part, b".") for part in (words, words.to_pylist()))
    assert one.symbols == other.symbols == sorted(set(words.to_pylist()) - {b"."})
    assert [c.tolist() for c in one.columns] == [c.tolist() for c in other.columns] and one.weights.tolist() == other.weights.tolist()
    assert phrases.tokens([]).to_pylist() == [] and len(automata.Windows.of(phrases.tokens(["", "."]), b".")) == 0
    rng = np.random.default_rng(1)
    for bits in (17, 32):
        pairs = rng.integers(0, [[1 << bits], [3], [1 << bits], [1 << bits]], (4, 3000)).astype(np.uint64)[:, rng.integers(0, 3000, 5000)]
        first, second = (pairs[i] << np.uint64(32) | pairs[i + 1] for i in (0, 2))
        order = automata._order_of_pairs(first, second, bits)
        assert list(zip(first[order].tolist(), second[order].tolist())) == sorted(zip(first.tolist(), second.tolist()))


def brute_phrases(rows, least, top, percent):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for size in range(1, 5):
                counts[lang or "und"].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        scored = []
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        for p, a in candidates.items():
            score, _, l, r = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            inside = [b for q, b in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if not any(100 * b >= percent * a for b in inside):
                scored.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def phrase_rows():
    random.seed(11)
    words = ["the", "of", "New", "YORK", "city", "ÉTÉ", "été", "naïve", "\x01odd", "a\x00b", "x"]
    rows = []
    for i in range(300):
        text = "".join(random.choice(words) + random.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b"]) for _ in range(random.randrange(60)))
        rows.append((random.choice(["en", "en", "en", "fr", None, "und", "x\ny"]), text + random.choice(["", " new york city of the", "the the the the the"])))
    return rows + [("en", None), (None, ""), ("de", "kein Satz"), ("en", "of the " * 5000)]


@pytest.mark.parametrize("range_runs, chunk, shard_runs", [(phrases.RANGE_RUNS, phrases.CHUNK, phrases.SHARD_RUNS), (64, 7, 200), (640, 50, 1)])
def test_phrases(spark, range_runs, chunk, shard_runs):
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, "lang string, text string").withColumn("phrase", F.lit(1)).withColumn("range", F.lit(2)).repartition(3)
    found = phrases.collocations(docs, least=5, top=40, range_runs=range_runs, chunk=chunk, shard_runs=shard_runs)
    got = [(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in found.collect()]
    assert sorted(got) == brute_phrases(rows, 5, 40, 80)


def test_phrases_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(empty).count() == 0
    rare = spark.createDataFrame([("en", "two words"), (None, None)], "lang string, text string")
    assert phrases.collocations(rare).collect() == []


# Ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_search(docs, items, top=20):
    words = [(i, TERM.findall((text or "").translate(LOWER))) for i, text in docs]
    words = [(i, Counter(found), len(found)) for i, found in words if found]
    whole, length = len(words), sum(n for _, _, n in words)
    holding = Counter(term for _, found, _ in words for term in found)
    out = []
    for item, text in dict.fromkeys(items):
        asked = Counter(TERM.findall((text or "").translate(LOWER)))
        scored = []
        for i, found, n in words:
            m = 75 + 25 * n * whole // length
            score = sum(
                k * math.floor(1000 * math.log((2 * whole + 2) / (2 * holding[t] + 1))) * (1_000_000_000 * found[t] // (1000 * found[t] + 12 * m))
                for t, k in asked.items() if t in found
            )
            if score > 0:
                scored.append((-score, i is not None, i or 0))
        out += [(item, rank, i if known else None, -s) for rank, (s, known, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def search_rows():
    random.seed(13)
    words = ["alpha", "Beta", "gamma", "alphabet", "bet", "ÉTÉ", "été", "x1", "1x", "naïve", "日本", "a", "the", "the", "the"]
    text = lambda n: "".join(random.choice(words) + random.choice([" ", "-", "_", ".", "  ", "\n", "'", "\x7f"]) for _ in range(n))
    docs = [(i, text(random.randrange(40))) for i in range(300)] + [(None, "alpha beta"), (5, None), (6, ""), (7, "...")] + [(900 + i, "gamma alpha") for i in range(60)]
    docs += [(400, "beta " * 30_000), (300, "x1 x1"), (300, "x1 x1")]
    items = [(i, text(random.randrange(12))) for i in range(30)] + [(None, "alpha gamma gamma"), (3, "beta"), (3, "beta"), (77, None), (78, ""), (79, "nowhere")]
    return docs, items


@pytest.mark.parametrize("block_chars, top", [(search.BLOCK_CHARS, 20), (300, 5)])
def test_search(spark, block_chars, top):
    docs, items = search_rows()
    left = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("n", F.lit("x")).withColumn("score", F.lit(0)).repartition(5)
    right = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(1))
    got = [(r.item_id, r["rank"], r.doc_id, r.score) for r in search.search(left, right, top, block_chars).collect()]
    assert sorted(got, key=str) == brute_search(docs, items, top)


def test_leaders_keep_the_best():
    random.seed(17)
    rows = [[random.randrange(4) for _ in range(3)] for _ in range(500)]
    leaders = search.Leaders(3, 6)
    for start in range(0, 500, 50):
        part = np.array(rows[start : start + 50], np.int64)
        leaders.offer(part, np.ones(50, np.int64), np.arange(start, start + 50))
        leaders.rows()
    got = leaders.rows()
    for item in range(3):
        want = sorted((-row[item], i) for i, row in enumerate(rows) if row[item] > 0)[:6]
        assert [(-s, i) for n, s, _, i in got.tolist() if n == item] == want


def test_search_without_items_or_documents(spark):
    docs, items = spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert search.search(docs.limit(0), items).count() == 0
    assert search.search(docs, items.limit(0)).count() == 0
    assert search.search(docs, items).columns == ["item_id", "rank", "doc_id", "score"]


def test_decontamination_shards_are_small(spark):
    """Text of 12 MB in one batch is indexed in shards of 4 MB at most, with the same spans as row by row."""
    from pressroom.llm import common

    phrase = " ".join(f"p{i}" for i in range(13))
    texts = pa.array([f"{'x ' * 1_000_000}{phrase} tail {i}" for i in range(6)])
    assert all(rows <= 2 for _, rows in common._slices(texts, decontaminate.SHARD_BYTES))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts.to_pylist())], "doc_id bigint, text string").coalesce(1)
    bench = spark.createDataFrame([("b", phrase)], "item_id string, text string")
    found = decontaminate.find_spans(docs, bench, "found", keep=["doc_id"]).collect()
    assert {r.doc_id: (r.found.n_words, list(r.found.spans)) for r in found} == {i: (1_000_015, [1_000_000, 1_000_013]) for i in range(6)}
