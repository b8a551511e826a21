"""BPE, decontamination, personal data, licences and HTML against plain Python."""

from __future__ import annotations

import base64
import hashlib
import html
import random
import re

import public_tokenizers
import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from pressroom.llm import bpe, decontaminate, html_text, licences, pii

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

ODD_TEXTS = [
    None, "", "   \n\t ", "a", "The the THE", "é" * 300, "漢字😀 mixed space", "x" * 50_000,
    "word " * 3_000, "aé́ b\x00c", "The the THE", "<|endoftext|> 12345 '''s",
]


def frame(spark, texts, extra=""):
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (2, "again")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return df.selectExpr("*", *[f"'x' AS `{c}`" for c in extra.split()])


@pytest.fixture(scope="module")
def codec():
    with open(RANKS, "rb") as file:
        return bpe.Codec(bpe.read_ranks(file.read()), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference_encoding():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tree_reduction_is_the_merge_order(codec, reference_encoding):
    random.seed(5)
    for alphabet in ("ab", "the and", "éà1 2", "aA ", " \n", "abcdefghijklmnop", "漢字😀é"):
        for n in (1, 33, 70, 500):
            text = "".join(random.choice(alphabet) for _ in range(n))
            data = text.encode()
            assert codec.reduce(data) == codec.merge(data) == codec._merge_long(data)
            assert codec.encode(text) == reference_encoding.encode_ordinary(text)


def test_join_is_exact_at_every_cut(codec):
    data = "unbelievably-tokenised  strings, 1234567".encode()
    for cut in range(len(data) + 1):
        assert codec.join(codec.reduce(data[:cut]), codec.reduce(data[cut:])) == codec.merge(data)


def test_tokenise_rows(spark, reference_encoding):
    docs = frame(spark, ODD_TEXTS, "result ids n_tokens")
    got = bpe.tokenise(docs, RANKS, public_tokenizers.PATTERN, outputs=tuple(bpe.OUTPUTS)).collect()
    assert len(got) == docs.count()
    for row in got[: len(ODD_TEXTS)]:
        text = ODD_TEXTS[row.doc_id] or ""
        ids = reference_encoding.encode_ordinary(text)
        assert row.ids == ids and row.n_tokens == len(ids) and row.round_trip
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert bytes(row.decoded) == text.encode()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.tokenise(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(docs, items):
    windows = {}
    for item, text in items:
        words = WORD.findall((text or "").translate(LOWER))
        for i in range(max(1, len(words) - 12) if words else 0):
            windows.setdefault(tuple(words[i : i + 13]), set()).add(str(item))
    out = []
    for doc, text in docs:
        words = WORD.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for size in set(map(len, windows)):
            for i in range(len(words) - size + 1):
                if owners := windows.get(tuple(words[i : i + size])):
                    hit.update(range(i, i + size))
                    found |= owners
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(words), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(words)))
    return out


@pytest.mark.parametrize("block_chars", [decontaminate.BLOCK_CHARS, 200])
def test_decontamination(spark, block_chars):
    random.seed(3)
    vocabulary = [f"w{i}" for i in range(12)] + ["É1", "ß"]
    say = lambda n: " ".join(random.choice(vocabulary) for _ in range(n))
    items = [(i, say(random.choice([1, 2, 5, 13, 14, 30]))) for i in range(12)]
    items += [(3, items[3][1]), (40, None), (41, "..."), (42, "repeat " * 20)]
    docs = [(i, t) for i, t in enumerate([None, "", "!!", "repeat " * 50, say(400), "x " * 2_000])]
    docs += [(20 + i, f"{say(9)} q {items[i % 12][1]}, {say(60)} {items[(i + 1) % 12][1].upper()}") for i in range(25)]
    docs += [(20, docs[6][1])]
    left = spark.createDataFrame(docs, "doc_id bigint, text string")
    right = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontaminate.find_spans(left, right, "r", keep=["doc_id"], block_chars=block_chars)
    hit = decontaminate.n_hit(F.col("r.spans"))
    got = found.select("doc_id", "r.n_words", hit, F.size("r.items"), F.sha2(F.array_join("r.items", ","), 256), decontaminate.contaminated("r"))
    assert sorted(map(tuple, got.collect())) == sorted(contamination(docs, items))
    assert decontaminate.report(left, right.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    assert decontaminate.report(left.limit(0), right).count() == 0


def test_fm_index_finds_every_occurrence():
    rng = np.random.default_rng(1)
    text = np.concatenate([np.append(rng.integers(1, 4, n), 0) for n in (5, 40, 1, 60)])
    index = decontaminate.FmIndex(text, 3)
    for size in (1, 2, 5):
        for start in range(len(text) - size):
            phrase = text[start : start + size]
            if (phrase == 0).any():
                continue
            low, high = index.search(phrase[None, :].astype(np.int64), np.array([size]))
            want = [i for i in range(len(text) - size + 1) if (text[i : i + size] == phrase).all()]
            assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == want


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            luhn = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits)))) if digits else 1
            good = {
                "email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")),
                "card": 16 <= len(digits) <= 19 and luhn % 10 == 0, "phone": 8 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


PRIVATE = [
    "mail a.b+c@d-e.co.uk, x@y, @z.com a@b.c@d.e", "1.2.3.4.5 256.1.1.1 001.002.3.255 1.2.3", "4111 1111-1111 1111 4111111111111112",
    "+1 (017) 555-7713 and +12 34 and +123456789012345678", "é 10.0.0.1 😀 me@x.org", "9" * 3_000, "a" * 3_000 + "@", "1" * 400 + ".2.3.4",
    "call +44 20 7946 0958 now; again 7946 0958", "+" * 500 + "1 " * 500, "a@" * 500,
]


def test_base_spans():
    for text in PRIVATE:
        assert pii.base_spans(text) == plain_spans(text), text[:60]
    random.seed(9)
    for _ in range(400):
        text = "".join(random.choice("0123459. -+()@ab%é\n") for _ in range(random.choice([10, 60, 200])))
        assert pii.base_spans(text) == plain_spans(text), text


def test_pii_report_and_mask(spark):
    docs = frame(spark, [None, "", *PRIVATE], "found masked")
    rows = pii.report(docs).collect()
    assert len(rows) == docs.count()
    texts = [None, "", *PRIVATE]
    for row in rows[: len(texts)]:
        base = plain_spans(texts[row.doc_id] or "")
        spelled = [f"{k}:{s}:{e}" for k, s, e in base]
        assert row.base_sha256 == hashlib.sha256(",".join(spelled).encode()).hexdigest()
        assert set(spelled) <= set(row.spans.split(",")) | {""}
        assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == tuple(sum(k == kind for k, _, _ in base) for kind in PATTERNS)
    masked = pii.masked(docs)
    assert masked.columns == docs.columns
    by_id = {r.doc_id: r.text for r in masked.where("doc_id <> 2").collect()}
    assert by_id[0] is None and by_id[6].startswith("é <IP> 😀 <EMAIL>")
    assert pii.report(docs.limit(0)).count() == 0 and pii.masked(docs.limit(0)).count() == 0


def test_field_spreads_labels_over_distance():
    """A number that is part of a phone number in one place gets its label in another."""
    text = "ring +1 (017) 555-7713 today " + "and then " * 40 + "ask 555-7713 again"
    base = pii.base_spans(text)
    counts = {("", 0, -1): 50, ("", 4, -1): 50}
    for kind in range(3):
        counts.update({(str(kind), 4, 4): 60, (str(kind), 0, 0): 60, (str(kind), 0, 4): 2})
    added = pii.Field.from_counts(counts).add([text, "555-7713 alone"], [base, []])
    assert added[0] == [("phone", text.rindex("555"), text.rindex("555") + 8)] and added[1] == []


def test_field_needs_no_base_match():
    """An unrelated match elsewhere in the document does not change the result of a token."""
    counts = {("", 0, -1): 50, ("", 4, -1): 50, ("bcall", 4, -1): 400, ("s000-0000", 4, -1): 400}
    for kind in range(3):
        counts.update({(str(kind), 4, 4): 60, (str(kind), 0, 0): 60, (str(kind), 0, 4): 2})
    text = "please call 555-7713 or wait"
    other = f"{text} {'and then ' * 40} write to me@x.org"
    added = pii.Field.from_counts(counts).add([text, other, "no token"], [pii.base_spans(t) for t in (text, other, "no token")])
    assert added == [[("phone", 12, 20)], [("phone", 12, 20)], []]


def parts_field():
    counts = {("", 0, -1): 500, ("", 4, -1): 500, ("bat", 4, -1): 900, ("bor", 4, -1): 900, ("s(000)", 4, -1): 10}
    counts |= {(name, 0, -1): 900 for name in ("bpage", "bof", "bin")}
    for kind in range(3):
        counts |= {(str(kind), 4, 4): 900, (str(kind), 0, 0): 900, (str(kind), 0, 4): 1}
    return pii.Field.from_counts(counts)


@pytest.mark.parametrize("number", ["555 010 1234", "(030) 123-4567", "0171 55 66 77", "030/123 45-67", "555-0101", "(0) 12 (34) 56"])
def test_a_number_is_labelled_whole(number):
    """A number in several parts without a plus sign: one span over all of it, brackets included."""
    text = f"call me at {number}, or write; see page x17 of x20"
    base = pii.base_spans(text)
    added = parts_field().add([text], [base])[0]
    start = text.index(number)
    assert added == [("phone", start, start + len(number))]


def test_a_number_is_labelled_whole_or_not_at_all():
    text = "see page 17 18 19 and at 20 21 22 too, in 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 of"
    added = parts_field().add([text], [[]])[0]
    for kind, start, end in added:
        assert text[start:end] in ("20 21 22", "17 18 19") and kind == "phone"
    units = pii._numbers(pii.tokens("a 1 2 3 b 4 5 x7 8 9 +1 (017) 555-7713 6", [("phone", 20, 37)]))
    assert all(last > first for first, last in units)


def test_long_tokens_are_looked_at_whole():
    long = "0" * 70
    assert pii._shape(long + "a1") != pii._shape(long + "1a") and pii._shape(long) == pii._shape("1" * 70)
    token = pii.tokens(long * 3, [])[0]
    assert "d210" in pii._features(long * 3, token)


def test_field_is_counted_in_all_documents(spark):
    texts = ["ring +1 (017) 555-7713 now"] * 40 + [f"see page {i} of 99" for i in range(60)] + [None, ""]
    docs = frame(spark, texts).repartition(7)
    field = pii.fit(docs)
    counts: dict = {}
    rows = [t or "" for (t,) in docs.select("text").collect()]
    for text in rows:
        found = pii.tokens(text, pii.base_spans(text))
        for token in found:
            for name in ["", *pii._features(text, token)]:
                counts[name, token.label, -1] = counts.get((name, token.label, -1), 0) + 1
        for a, b, kind in pii._edges(found):
            key = (str(kind), found[a].label, found[b].label)
            counts[key] = counts.get(key, 0) + 1
    want = pii.Field.from_counts(counts)
    assert field.weights.keys() == want.weights.keys() and np.allclose(field.pairs, want.pairs) and np.allclose(field.prior, want.prior)
    assert all(np.allclose(field.weights[name], row) for name, row in want.weights.items())
    few = pii.fit(docs, most_features=3).weights
    assert few.keys() < want.weights.keys() and sum(len(name) > 1 for name in few) == 3


def settled(field, unary, edges, rounds):
    """Plain sum-product with very many rounds."""
    links = [(a, b, k) for a, b, k in edges] + [(b, a, k) for a, b, k in edges]
    sent = {link: np.ones(unary.shape[1]) for link in links}
    into = {i: [link for link in links if link[1] == i] for i in range(len(unary))}
    for _ in range(rounds):
        new = {}
        for a, b, k in links:
            out = np.exp(unary[a])
            for link in into[a]:
                if link != (b, a, k):
                    out = out * sent[link] / sent[link].sum()
            out = out @ np.exp(field.pairs[k])
            new[a, b, k] = out / out.sum()
        sent = new
    rows = [np.exp(u) * np.prod([sent[link] for link in into[i]], axis=0) for i, u in enumerate(unary)]
    return np.array([row / row.sum() for row in rows])


@pytest.mark.parametrize("repeats, strength", [(30, 60), (30, 5_000), (150, 5_000)])
def test_field_settles_over_many_repeats(repeats, strength):
    counts = {("", label, -1): 50 for label in range(5)}
    counts |= {(str(kind), a, b): strength if a == b else 2 for kind in range(3) for a in range(5) for b in range(a, 5)}
    field = pii.Field.from_counts(counts)
    text = "ring +1 (017) 555-7713 today " + "and ask 555-7713 again " * repeats
    found = pii.tokens(text, pii.base_spans(text))
    edges = pii._edges(found)
    unary = np.array([np.where(np.arange(5) == t.label, 0.0, -30.0) if t.label else field.prior for t in found])
    got = field.beliefs(unary, np.array(edges))
    assert np.abs(got - settled(field, unary, edges, 2 * repeats + 20)).max() < 1e-4
    more = np.array(edges + [(a + len(found), b + len(found), k) for a, b, k in edges[:2]])
    owner = np.array([0] * len(found) + [1] * len(found))
    assert np.array_equal(field.beliefs(np.concatenate((unary, unary)), more, owner)[: len(found)], got), "slices do not matter"


def test_licences(spark):
    apache = "Licensed under the Apache License, Version 2.0."
    full = next(t for n, t in licences.TEMPLATES if n == "ISC")
    texts = [None, "", "nothing here", f"prose\n{apache}\nmore prose", f"word {full.upper()} word {full}", "Licensed under", apache * 3]
    docs = frame(spark, texts, "found")
    got = {r.doc_id: r for r in licences.report(docs).where("doc_id <> 2").collect()}
    assert got[3].licences == "Apache-2.0" and got[3].best_dice == 1.0 and got[3].n_matches == 1
    assert got[4].licences == "ISC" and got[4].n_matches == 2
    assert got[6].n_matches == 3 and got[0].n_matches == got[1].n_matches == got[5].n_matches == 0 and got[0].best_dice is None
    assert licences.report(docs.limit(0)).count() == 0


GNU = "This {} is free software{} you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."
BSD = (
    "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n"
    "{}Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "{}Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
    "in the documentation and/or other materials provided with the distribution.\n"
)
THIRD = "{}Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
AS_IS = 'THIS SOFTWARE IS PROVIDED BY {} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'
HOLDERS = "THE COPYRIGHT HOLDERS AND CONTRIBUTORS"


@pytest.mark.parametrize("work", ["program", "library", "file"])
def test_gnu_notices_and_their_neighbours(work):
    scanner = licences.Scanner(licences.TEMPLATES, licences.THRESHOLD)
    for name, kind, version in (
        ("GPL-2.0", "General Public License", "2"), ("GPL-3.0", "General Public License", "3"), ("AGPL-3.0", "Affero General Public License", "3"),
        ("LGPL-2.0", "Library General Public License", "2"), ("LGPL-2.1", "Lesser General Public License", "2.1"),
        ("LGPL-3.0", "Lesser General Public License", "3"),
    ):
        notice = GNU.format(work, ":", kind, ",", version)
        for text in (notice, f"some prose before {notice} and some prose after it"):
            assert [m[0] for m in scanner.scan(text)] == [name], (name, work)


@pytest.mark.parametrize("marks", [("1. ", "2. ", "3. "), ("* ", "* ", "* ")])
@pytest.mark.parametrize("who", [HOLDERS, "THE AUTHOR"])
def test_bsd_notices_and_their_neighbours(marks, who):
    scanner = licences.Scanner(licences.TEMPLATES, licences.THRESHOLD)
    two, end = BSD.format(*marks[:2]), AS_IS.format(who)
    assert [m[0] for m in scanner.scan(f"prose {two}{end}")] == ["BSD-2-Clause"]
    for holder in ("the copyright holder", "the University"):
        assert [m[0] for m in scanner.scan(f"prose {two}{THIRD.format(marks[2], holder)}{end}")] == ["BSD-3-Clause"]
    assert [m[0] for m in scanner.scan(two + end + " " + two + THIRD.format(marks[2], "it") + end)] == ["BSD-2-Clause", "BSD-3-Clause"]


def brute_licences(text, threshold):
    """Every window of every template's length."""
    words, best = licences.normal_words(text), 0.0
    grams = lambda ws: licences.Counter(zip(ws, ws[1:]))
    for _, template in licences.TEMPLATES:
        want = licences.normal_words(template)
        size = min(len(want), len(words))
        for i in range(len(words) - size + 1):
            best = max(best, licences.dice(grams(words[i : i + size]), grams(want)))
    return best if best >= threshold else None


def test_licence_windows_are_complete():
    random.seed(2)
    scanner = licences.Scanner(licences.TEMPLATES, 0.7)
    pieces = [w for _, t in licences.TEMPLATES[:5] for w in t.split()]
    for _ in range(60):
        text = " ".join(pieces[i : i + 9] and " ".join(pieces[i : i + 9]) for i in (random.randrange(len(pieces)), random.randrange(len(pieces))))
        found = scanner.scan(text)
        assert max((m[1] for m in found), default=None) == brute_licences(text, 0.7)


PAGES = [
    ("http://a.org/1", '<body class="has-sidebar"><nav><a href="/x">menu</a></nav><div class="post-17"><h1>Title &amp; more</h1><p>One  two\n three'
     '<p>four <b>five<br>six</b></p><div class="ad">buy</div><ul><li>i<li>j</ul><form>f</form><section id="comments"><p>reader says a lot here</p></section>'
     '<script>var a="</p><p>no";</script></div><aside>side</aside><footer>foot</footer></body>'),
    ("http://a.org/2", '<body><div class="post-18"><p>' + "Long text. " * 20 + '</p></div><div class="box"><p>' + "junk " * 3 + "</p></div></body>"),
    ("http://a.org/3", '<body><div class="post-19"><p>short</p></div><div class="other"><p>' + "recommended words " * 9 + "</p></div></body>"),
    (None, None), ("", ""), ("not a url", "plain < text &copy; 2 &#233; <unclosed"), ("http://b.org", "<p>a<p>b"), ("http://b.org", "<!-- only -->"),
    ("http://b.org/deep", "<div>" * 3_000 + "deep" + "</div>" * 3_000),
]


def test_html(spark):
    rows = [(i, u, h) for i, (u, h) in enumerate(PAGES)] + [(None, *PAGES[0]), (0, *PAGES[0])]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'x' AS host", "1 AS text")
    got = html_text.extract(pages).collect()
    assert len(got) == len(rows)
    text = {r.page_id: r.text for r in got}
    assert text[0] == text[None] == "Title & more\nOne two three\nfour five six\ni\nj"
    assert text[2] == "short", "the host's path wins over the page's own choice"
    assert text[3] == text[4] == text[7] == "" and text[5] == "plain < text © 2 é" and text[6] == "a\nb" and text[8] == "deep"
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract(pages.limit(0)).count() == 0


WHOLE = [
    ("http://c.org/1", "<body><nav>menu</nav><article><h1>Head</h1><p>lead</p><div class=body><p>" + "long text " * 50 + "</p></div></article></body>"),
    ("http://d.org/1", "<body><article><section class=a><p>" + "one " * 85 + "</p></section><section class=b><p>" + "two " * 15 + "</p></section></article></body>"),
    ("http://e.org/1", "<body><div class=page><h2>Head</h2><div class=body><p>" + "long text " * 50 + "</p></div><p><a href=/x>see also</a></p></div><footer>foot</footer></body>"),
    ("http://f.org/1", "<body><main><div class=body><p>only a body</p></div></main></body>"),
    ("http://f.org/2", "<body><main><div class=body><p>another body</p></div></main></body>"),
    ("http://f.org/3", "<body><main><h1>Head</h1><p>lead</p><div class=body><p>third body</p></div></main></body>"),
]


def test_html_keeps_what_stands_beside_the_body(spark):
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(WHOLE)], "page_id bigint, url string, html string")
    text = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    long = ("long text " * 50).strip()
    assert text[0] == f"Head\nlead\n{long}" and text[1] == f"{('one ' * 85).strip()}\n{('two ' * 15).strip()}"
    assert text[2] == f"Head\n{long}\nsee also" and text[5] == "Head\nlead\nthird body"


def story(n, words=60):
    rng = random.Random(n)
    return [" ".join(f"{rng.choice('bcdfg')}{rng.randrange(10_000)}" for _ in range(words)).capitalize() + "." for _ in range(3)]


# Layouts: of a page's number and its paragraphs, without names that tell what a part is, or with misleading ones.
HEAD = "<title>t</title>"
LAYOUTS = {
    "named by place": lambda n, ps: f"<body><div class=top><a href=/>Home</a> <a href=/n>News</a></div><div class=story><h1>Head {n}</h1>"
    + "".join(f"<p>{p}</p>" for p in ps) + "</div><div id=right><p>Most read item</p></div></body>",
    "no classes": lambda n, ps: f"<body><div><a href=/>Home</a> | <a href=/n>News</a></div><div><h1>Head {n}</h1>"
    + "".join(f"<p>{p}</p>" for p in ps) + "</div><div><p>We use cookies to improve your visit.</p></div></body>",
    "misleading sections": lambda n, ps: f"<body><nav><a href=/>Home</a></nav><article><h1>Head {n}</h1><section class='social-policy'><p>{ps[0]}</p></section>"
    f"<div class='related-work'><p>{ps[1]}</p></div><div class='banner-year notice'><p>{ps[2]}</p></div></article><footer>foot</footer></body>",
    "head beside the body": lambda n, ps: f"<body><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul><h1>Head {n}</h1><div class=txt>"
    + "".join(f"<p>{p}</p>" for p in ps) + f"</div><div class=strip><a href=/a{n}>One more</a><a href=/b{n}>And another</a></div></body>",
    "table": lambda n, ps: f"<table><tr><td><a href=/>Home</a></td><td><h1>Head {n}</h1>" + "".join(f"<p>{p}</p>" for p in ps)
    + "</td></tr></table><div>Printed in town, all rights reserved</div>",
    "comments and adverts inside": lambda n, ps: f"<body><main><h1>Head {n}</h1><p>{ps[0]}</p><div class='ad-slot'>Buy {n} now</div><p>{ps[1]}</p><p>{ps[2]}</p>"
    f"<div id='comment-list'><p>reader {n} thinks {story(n + 900)[0]}</p></div></main><div class=sidebar><p>Weather {n}</p></div></body>",
    "links in the text": lambda n, ps: f"<body><article><h1>Head {n}</h1><p>{ps[0]}</p><p>{ps[1]}</p><ul><li><a href=/s{n}>{ps[2]}</a></ul></article>"
    f"<div><a href=/q{n}>Elsewhere {n}</a></div></body>",
}


@pytest.mark.parametrize("name", list(LAYOUTS))
def test_html_layouts(spark, name):
    """Five pages of one host: the article whole, and nothing else, whatever its parts are called."""
    rows = [(n, f"http://{LAYOUTS[name].__code__.co_firstlineno}.org/{n}", f"<html><head>{HEAD}</head>{LAYOUTS[name](n, story(n))}</html>") for n in range(5)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    assert got == {n: "\n".join([f"Head {n}", *story(n)]) for n in range(5)}


def test_html_copies_of_one_page_keep_their_text(spark):
    """Where everything recurs, recurrence proves nothing."""
    page = LAYOUTS["misleading sections"](1, story(1))
    pages = spark.createDataFrame([(n, "http://copies.org/x", page) for n in range(6)], "page_id bigint, url string, html string")
    assert {r.text for r in html_text.extract(pages).collect()} == {"\n".join(["Head 1", *story(1)])}


def plain_extract(pages):
    """The whole query in plain Python: recurrence, votes and extraction with dictionaries."""
    from collections import Counter, defaultdict

    hosts = defaultdict(list)
    for i, url, page in pages:
        hosts[re.sub(r"^\w+://([^/]*).*$", r"\1", url).lower()].append((i, page))
    out = {}
    for rows in hosts.values():
        seen = Counter()
        for _, page in rows:
            seen.update({text for e in html_text._in_order(html_text.read(page)) for _, text, _ in e.blocks})
        recurring = frozenset(html_text.text_number(t) for t, n in seen.items() if n >= 3 and 2 * n >= len(rows))
        votes = defaultdict(lambda: [0, 0])
        for _, page in rows:
            best = html_text.own_container(html_text.judge(html_text.read(page), recurring))
            if best:
                votes[best.path][0] += 1
                votes[best.path][1] += best.good
        path = max(((n, size, path) for path, (n, size) in votes.items()), default=(0, 0, None))[2]
        out |= {i: html_text.main_text(page, path, recurring) for i, page in rows}
    return out


def test_html_query_equals_plain_python(spark):
    rows = []
    for i in range(60):
        rng = random.Random(i)
        layout = LAYOUTS[rng.choice(list(LAYOUTS))]
        rows.append((i, f"http://h{rng.randrange(6)}.org/{i}", layout(i, story(i % 40, rng.randrange(1, 30)))))
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(5)
    assert {r.page_id: r.text for r in html_text.extract(pages).collect()} == plain_extract(rows)


def test_html_template_of_the_tables(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    for row in pages.collect():
        article = re.search("<article>(.*)</article>", row.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("</?b>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", article))
        assert got[row.page_id] == "\n".join(b for b in blocks if b)


def test_html_counts_of_a_host_read_each_page_once(spark):
    """The numbers of pages come without a second run of the kernel, and count pages without text too."""
    rows = [("a.org", f"<p>one</p><p>own {n}</p>{'<p>half</p>' * (n < 3)}{'<p>few</p>' * (n < 2)}") for n in range(6)]
    rows += [("b.org", "<p>two</p>"), ("b.org", "<p>two</p>"), ("a.org", None), ("c.org", "")]
    found = html_text.recurring_texts(spark.createDataFrame(rows, "host string, html string"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert {r.host: r.recurring for r in found.collect()} == {"a.org": [html_text.text_number("one")]}
