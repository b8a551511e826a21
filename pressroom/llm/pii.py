"""Personal data: fixed patterns, and a skip-chain conditional random field that adds to them.

Patterns give the base spans; those always stay. The field works on the tokens of a document that hold
a digit or an at-sign. Neighbouring tokens are linked; a token is also linked, however far away, with
the one before it that has the same characters, and with the one before it of the same shape. Tokens
inside base spans are observed. Loopy message passing, until it settles, then spreads the labels: a number that stands in
a full phone number in one place and alone in another gets one label in both. Tokens outside base
spans whose belief is above ``BELIEF`` become further spans. The parts of one number, such as ``555 010 1234``
or ``(030) 123-4567``, are decided together: one span, or none.

The field is trained in pieces: token features, neighbour pairs and skip pairs are counted in all documents,
labelled by the patterns, and summed before the shuffle. At most ``MOST_FEATURES`` token features, the most
frequent ones, get a weight, so what the tasks are sent is bounded. Scoring is one pass without a shuffle
over every document with such a token; some documents together are one graph for the arithmetic.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressroom.llm.common import attach, fresh, settle

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
MOST_FEATURES = 100_000
MOST_DIGITS = 19  # of a number in several parts
BELIEF = 0.9
ROUNDS = 50  # of all documents of a graph together, before single ones go on in sweeps
FULL_SWEEPS = 50
TOLERANCE = 1e-6
DAMPING = 0.3
FEATURE_SCALE = 0.5
LEAST_COUNT = 3
MOST_NODES = 50_000  # of one graph, if it holds more than one text

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits that fails from its start fails from every later digit too: no second try inside it.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"\S*[0-9@]\S*")
_EDGE = "()[]{}<>\"'.,;:!?*#$%&="


def _emails(text: str) -> list[tuple[int, int]]:
    out, floor = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
            floor = domain.end()
        else:
            floor = at + 1
        at = text.find("@", at + 1)
    return out


def _small(part: str) -> bool:
    part = part.lstrip(".").lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def _luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(map(int, reversed(digits))):
        total += digit if i % 2 == 0 else digit * 2 - 9 * (digit > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind and start; each kind on its own."""
    out = [("email", *span) for span in _emails(text)]
    for m in _IP.finditer(text):
        if _small(text[m.start() : m.start(1)]) and all(map(_small, m.groups())):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(map(str.isdigit, m.group())) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


@dataclass
class Token:
    start: int
    end: int
    text: str
    shape: str
    label: int  # of the base span it touches, else 0
    following: bool  # nothing but white space between it and the token before


def _shape(token: str) -> str:
    """Digits as 0, runs of letters as a; a long shape is told by its hash."""
    kinds = re.sub(r"a+", "a", "".join("0" if c.isdigit() else "a" if c.isalpha() else c for c in token))
    return kinds if len(kinds) <= 64 else "~" + hashlib.blake2b(kinds.encode(), digest_size=12).hexdigest()


def tokens(text: str, spans: list[tuple[str, int, int]]) -> list[Token]:
    """Tokens with a digit or an at-sign, without marks around them."""
    borders = sorted((start, end, LABELS.index(kind)) for kind, start, end in spans)
    out, next_span, last = [], 0, -2
    for m in _TOKEN.finditer(text):
        body = m.group()
        left = len(body) - len(body.lstrip(_EDGE))
        body = body.strip(_EDGE)
        if not body:
            continue
        start = m.start() + left
        end = start + len(body)
        while next_span < len(borders) and borders[next_span][1] <= start:
            next_span += 1
        label = borders[next_span][2] if next_span < len(borders) and borders[next_span][0] < end else 0
        out.append(Token(start, end, body, _shape(body), label, m.start() - last <= 1))
        last = m.end()
    return out


def _features(text: str, token: Token) -> list[str]:
    before = text[max(0, token.start - 24) : token.start].rstrip(_EDGE).split()
    after = text[token.end : token.end + 24].split()
    digits = sum(map(str.isdigit, token.text))
    marks = "".join(c for c in "@+.-()/:_=" if c in token.text)
    return [
        f"s{token.shape}", f"d{digits}", f"m{marks}{any(map(str.isalpha, token.text))}",
        f"b{before[-1].lower()[:12] if before else ''}", f"a{after[0].lower()[:12] if after else ''}",
    ]


def _edges(found: list[Token], offset: int = 0) -> list[tuple[int, int, int]]:
    """(node, node, type): 0 neighbours, 1 same characters, 2 same shape."""
    out: list[tuple[int, int, int]] = []
    same: dict[str, int] = {}
    alike: dict[str, int] = {}
    for i, token in enumerate(found, offset):
        if token.following and i > offset:
            out.append((i - 1, i, 0))
        if token.text in same:
            out.append((same[token.text], i, 1))
        elif token.shape in alike:
            out.append((alike[token.shape], i, 2))
        same[token.text] = alike[token.shape] = i
    return out


def _numbers(found: list[Token]) -> list[tuple[int, int]]:
    """First and last of the tokens that are the parts of one number: unlabelled, nothing but white space or the
    brackets and marks of a number between them, digits and such marks only, and not too many digits."""
    out, first = [], 0
    plain = [not t.label and not any(map(str.isalpha, t.text)) and "@" not in t.text for t in found]
    for i in range(1, len(found) + 1):
        if i < len(found) and found[i].following and plain[i] and plain[i - 1]:
            continue
        if i - first > 1 and sum(map(str.isdigit, "".join(t.text for t in found[first:i]))) <= MOST_DIGITS:
            out.append((first, i - 1))
        first = i
    return out


@dataclass
class Field:
    """Log potentials: of features, and of label pairs for the three types of links."""

    prior: np.ndarray
    weights: dict[str, np.ndarray]
    pairs: np.ndarray

    @classmethod
    def from_counts(cls, counts: dict[tuple[str, int, int], int]) -> Field:
        """From counts of (feature, label, -1) and (link type as text, label, label)."""
        n = len(LABELS)
        labels, features = np.ones(n), {}
        pairs = np.ones((3, n, n))
        for (name, x, y), count in counts.items():
            if y >= 0:
                pairs[int(name), x, y] += count
                pairs[int(name), y, x] += count
            elif name == "":
                labels[x] += count
            else:
                features.setdefault(name, np.zeros(n))[x] += count
        weights = {
            name: FEATURE_SCALE * (np.log((c + 0.1) / (c.sum() + 0.1 * n)) - np.log(labels / labels.sum()))
            for name, c in features.items()
            if c.sum() >= LEAST_COUNT
        }
        joint = pairs / pairs.sum(axis=(1, 2), keepdims=True)
        single = joint.sum(axis=2)
        return cls(np.log(labels / labels.sum()), weights, np.log(joint / (single[:, :, None] * single[:, None, :])))

    def beliefs(self, unary: np.ndarray, edges: np.ndarray, owner: np.ndarray | None = None) -> np.ndarray:
        """Label probabilities by loopy sum-product; every link carries one message each way.

        ``owner``: number of the document of each node. A document is done when none of its messages changes
        by more than ``TOLERANCE``, whatever the others do. All messages of a round are passed together; what
        has not settled after ``ROUNDS`` goes on in sweeps along the text.
        """
        total = unary.copy()
        if len(edges):
            owner = np.zeros(len(unary), np.int64) if owner is None else owner
            source = np.concatenate((edges[:, 0], edges[:, 1]))
            target = np.concatenate((edges[:, 1], edges[:, 0]))
            kind = np.concatenate((edges[:, 2], edges[:, 2]))
            back = np.concatenate((np.arange(len(edges)) + len(edges), np.arange(len(edges))))
            messages = np.zeros((len(source), len(LABELS)))
            potential = np.exp(self.pairs)
            active = np.arange(len(source))
            for _ in range(ROUNDS):
                held = unary.copy()
                np.add.at(held, target[active], messages[active])
                out = held[source[active]] - messages[back[active]]
                out = np.exp(out - out.max(axis=1, keepdims=True))
                new = np.empty_like(out)
                for k in range(len(potential)):
                    rows = kind[active] == k
                    new[rows] = np.einsum("ei,ij->ej", out[rows], potential[k])
                new = np.log(new + 1e-300)
                new -= new.max(axis=1, keepdims=True)
                change = np.abs(new - messages[active]).max(axis=1)
                messages[active] = DAMPING * messages[active] + (1 - DAMPING) * new
                of = owner[source[active]]
                active = active[np.isin(of, of[change > TOLERANCE])]
                if not len(active):
                    break
            if len(active):
                order = active[np.argsort(owner[source[active]], kind="stable")]
                for part in np.split(order, np.flatnonzero(np.diff(owner[source[order]])) + 1):
                    self._sweep(unary, source, target, kind, back, messages, potential, part)
            np.add.at(total, target, messages)
        total = np.exp(total - total.max(axis=1, keepdims=True))
        return total / total.sum(axis=1, keepdims=True)

    @staticmethod
    def _sweep(unary, source, target, kind, back, messages, potential, part: np.ndarray) -> None:
        """Settle the messages ``part`` of one document, forth and back in the order of the text.

        One sweep carries evidence along a chain of any length. Messages that go round in circles without
        a fixed point are brought to rest by ever smaller steps.
        """
        forth = part[source[part] < target[part]]
        behind = part[source[part] > target[part]]
        order = np.concatenate((forth[np.argsort(source[forth], kind="stable")], behind[np.argsort(-source[behind], kind="stable")])).tolist()
        low = source[part].min()
        step, number, moved = 1.0, 0, np.inf
        while step * moved > TOLERANCE:
            held = unary[low : source[part].max() + 1].copy()
            np.add.at(held, target[part] - low, messages[part])
            moved = 0.0
            for m in order:
                out = held[source[m] - low] - messages[back[m]]
                new = np.log(np.exp(out - out.max()) @ potential[kind[m]] + 1e-300)
                change = new - new.max() - messages[m]
                moved = max(moved, float(np.abs(change).max()))
                messages[m] += step * change
                held[target[m] - low] += step * change
            number += 1
            step *= 1.0 if number < FULL_SWEEPS else 0.9

    def add(self, texts: list[str], bases: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
        """Further spans of each text. Only texts with a token outside base spans need the field.

        Texts are independent; some are put into one graph, up to ``MOST_NODES`` tokens, for the arithmetic.
        """
        added: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        nodes: list[tuple[int, Token]] = []
        unary, edges, parts = [], [], {}
        for row, (text, base) in enumerate(zip(texts, bases)):
            found = tokens(text, base)
            if all(token.label for token in found):
                continue
            parts.update((len(nodes) + first, len(nodes) + last) for first, last in _numbers(found))
            if len(nodes) + len(found) > MOST_NODES:
                self._decide(texts, nodes, unary, edges, parts, added)
                nodes, unary, edges, parts = [], [], [], {}
            edges += _edges(found, len(nodes))
            for token in found:
                nodes.append((row, token))
                if token.label:
                    score = np.full(len(LABELS), -30.0)
                    score[token.label] = 0.0
                else:
                    score = self.prior + sum(self.weights.get(f, 0.0) for f in _features(text, token))
                unary.append(score)
        self._decide(texts, nodes, unary, edges, parts, added)
        return added

    def _decide(self, texts: list[str], nodes: list, unary: list, edges: list, parts: dict[int, int], added: list) -> None:
        """Put the spans of whole texts into ``added``. ``parts``: first and last token of numbers in several parts."""
        if not nodes:
            return
        belief = self.beliefs(np.array(unary), np.array(edges, np.int64).reshape(-1, 3), np.array([row for row, _ in nodes]))
        at = 0
        while at < len(nodes):
            row, token = nodes[at]
            last = parts.get(at, at)
            # Of a number in parts the mean of the logarithms counts.
            chance = np.exp(np.log(belief[at : last + 1] + 1e-300).mean(axis=0))
            label = int(chance[1:].argmax()) + 1
            if not token.label and chance[label] > BELIEF:
                start, end = token.start, nodes[last][1].end
                if texts[row][:start].endswith("(") and ")" in texts[row][start:end]:
                    start -= 1
                added[row].append((LABELS[label], start, end))
            at = last + 1


def fit(documents: DataFrame, most_features: int = MOST_FEATURES) -> Field:
    """Count the pieces of the field in all documents (text)."""

    def kernel(column: pa.Array) -> dict[str, list]:
        counts: Counter = Counter()
        for text in column.to_pylist():
            found = tokens(text or "", base_spans(text or ""))
            for token in found:
                counts["", token.label, -1] += 1
                counts.update((f, token.label, -1) for f in _features(text, token))
            counts.update((str(kind), found[a].label, found[b].label) for a, b, kind in _edges(found))
        # The counts of the whole slice, with its first row.
        rows = [{"name": k[0], "x": k[1], "y": k[2], "n": n} for k, n in counts.items()]
        return {"counts": [rows, *[[]] * (len(column) - 1)]}

    kinds = "counts array<struct<name string, x int, y int, n bigint>>"
    held = attach(documents.select("text"), ["text"], kernel, kinds, "found", keep=[])
    summed = held.select(F.explode("found.counts").alias("c")).groupBy("c.name", "c.x", "c.y").agg(F.sum("c.n").alias("n"))
    # Names of one character are the labels and the three types of links; all others are token features.
    summed = settle(summed, "pii-counts")
    few = summed.where("length(name) < 2")
    features = summed.where("length(name) > 1").groupBy("name").agg(F.sum("n").alias("n"), F.collect_list(F.struct("x", "n")).alias("by_label"))
    features = features.where(F.col("n") >= LEAST_COUNT).orderBy(F.desc("n"), "name").limit(most_features)
    counts = {(row["name"], row.x, row.y): row.n for row in few.collect()}
    counts |= {(row["name"], x, -1): n for row in features.collect() for x, n in row.by_label}
    return Field.from_counts(counts)


def find(documents: DataFrame, field: Field, name: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` and a struct ``name``: base and added, arrays of (kind, start, end) in code points."""
    shared = documents.sparkSession.sparkContext.broadcast(field)

    def kernel(column: pa.Array) -> dict[str, list]:
        texts = [t or "" for t in column.to_pylist()]
        base = [base_spans(t) for t in texts]
        added = shared.value.add(texts, base)
        as_rows = lambda spans: [{"kind": k, "start": s, "end": e} for k, s, e in spans]
        return {"base": [as_rows(b) for b in base], "added": [as_rows(a) for a in added]}

    span = "array<struct<kind string, start int, end int>>"
    return attach(documents, [text], kernel, f"base {span}, added {span}", name, keep=keep)


def _spelled(spans) -> F.Column:
    """kind:start:end by kind as listed, then start, comma-joined."""
    ranked = F.transform(
        spans,
        lambda s: F.struct(
            F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")
        ),
    )
    return F.array_join(F.transform(F.array_sort(ranked), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    NULL and empty texts have no spans. Repeated rows give repeated results, an empty table none.
    """
    found = find(documents, fit(documents), "found", keep=["doc_id"])
    kinds = F.transform("found.base", lambda span: span["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(_spelled(F.col("found.base")), 256).alias("base_sha256"),
        _spelled(F.concat("found.base", "found.added")).alias("spans"),
    )


def masked(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` with every span of ``text`` replaced by its kind in angle brackets; NULL stays NULL."""
    field = documents.sparkSession.sparkContext.broadcast(fit(documents))

    def kernel(column: pa.Array) -> dict[str, list]:
        raw = column.to_pylist()
        texts = [t or "" for t in raw]
        base = [base_spans(t) for t in texts]
        out = []
        for value, t, spans, more in zip(raw, texts, base, field.value.add(texts, base)):
            parts, last = [], 0
            for start, end, kind in sorted((s, e, k) for k, s, e in spans + more):
                if start >= last:
                    parts += (t[last:start], f"<{kind.upper()}>")
                last = max(last, end)
            out.append(None if value is None else "".join(parts) + t[last:])
        return {"text": out}

    name = fresh(documents, "masked")
    others = [c for c in documents.columns if c != text]
    found = attach(documents, [text], kernel, "text string", name, keep=others)
    return found.select(*[F.col(f"{name}.text").alias(text) if c == text else F.col(f"`{c}`") for c in documents.columns])


