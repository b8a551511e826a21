"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration.

The classifier is fitted on a bounded sample of labelled documents (``SAMPLE_ROWS``, the first ones in
the order of a hash of the id, so the sample is spread over the corpus and repeatable). From these come

* the lexicon: words, and beginnings of words, that stand mostly in toxic documents, each with the
  logarithm of its odds; at most ``LEXICON_SIZE`` of each kind, so the broadcast is bounded;
* boosted trees over densities of lexicon words, their nearness to a second person, capitals,
  punctuation and disguised spellings;
* an isotonic curve from the trees' probability to the share of toxic documents, fitted on rows the
  trees have not seen.

Scoring is one pass over all documents without a shuffle.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressroom.llm.common import attach, fresh, settle

SAMPLE_ROWS = 20_000
LEXICON_SIZE = 5_000
LEAST_DOCUMENTS = 6
LEAST_ODDS = 6.0
THRESHOLD = 0.7
NEAR = 4
BEGINNING = 5

SEEDS = (
    "idiot", "moron", "loser", "stupid", "trash", "scum", "pathetic", "worthless", "disgusting", "clown",
    "dumb", "imbecile", "vermin", "bastard", "hate",
)
SECOND_PERSON = frozenset(
    ("you", "your", "yours", "yourself", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "sie", "tu", "te", "toi",
     "ton", "ta", "vous", "votre", "vos", "tú", "ti", "usted", "ustedes", "vosotros")
)
_WORD = re.compile(r"[^\W\d_]+")
_DISGUISED = re.compile(r"(?<!\S)(?=\S*[^\W\d_])(?=\S*[\d@$*!|.\-_])[^\s]{3,}(?!\S)")
_PLAIN = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l",
                        "*": None, ".": None, "-": None, "_": None})
FEATURES = (
    "log_words", "weight_density", "hit_density", "hits", "kinds", "heaviest", "beginning_density", "beginnings",
    "seed_density", "second_person", "near_share", "disguised_rate", "disguised_hits", "capitals", "shouted",
    "exclamations", "questions", "punctuation",
)


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def measure(text: str, lexicon: dict[str, float], beginnings: dict[str, float]) -> list[float]:
    """The features of one text; an empty text gives zeros."""
    found = words(text)
    n, length = max(1, len(found)), max(1, len(text))
    at = [i for i, w in enumerate(found) if w in lexicon]
    weights = [lexicon[found[i]] for i in at]
    starts = [beginnings[b] for w in found if (b := w[:BEGINNING]) in beginnings and len(w) > BEGINNING]
    persons = [i for i, w in enumerate(found) if w in SECOND_PERSON]
    near = 0
    for i in at:  # both lists are sorted
        first = bisect_left(persons, i - NEAR)
        near += first < len(persons) and persons[first] <= i + NEAR
    disguised = [m.lower() for m in _DISGUISED.findall(text)]
    unmasked = sum(p in lexicon and p != d for d in disguised if (p := d.translate(_PLAIN)))
    upper = sum(map(str.isupper, text)) if not text.islower() else 0
    shouted = sum(w.isupper() and len(w) > 1 for w in text.split()) if upper else 0
    marks = text.count("!"), text.count("?"), text.count(".") + text.count(",") + text.count(";") + text.count(":")
    return [
        math.log1p(len(found)), sum(weights) / n, len(at) / n, float(len(at)), float(len({found[i] for i in at})),
        max(weights, default=0.0), sum(starts) / n, float(len(starts)), sum(w in _SEEDS for w in found) / n,
        len(persons) / n, near / max(1, len(at)), len(disguised) / n, float(unmasked), upper / length, shouted / n,
        marks[0] / n, marks[1] / n, marks[2] / n,
    ]


_SEEDS = frozenset(SEEDS)


@dataclass
class ToxicityModel:
    """A fitted scorer. ``trees`` is None if the labels do not hold both classes."""

    lexicon: dict[str, float]
    beginnings: dict[str, float]
    trees: GBTClassificationModel | None
    curve: IsotonicRegressionModel | None

    def score(self, documents: DataFrame, name: str, text: str = "text") -> DataFrame:
        """``documents`` with a double column ``name``; NULL text is an empty text."""
        found = _features(documents, self.lexicon, self.beginnings, text, feature := fresh(documents, "features"))
        if self.trees is None:
            hits, density = (F.col(feature)[FEATURES.index(k)] for k in ("hits", "hit_density"))
            return found.select(
                *documents.columns, F.when((hits >= 2) & (density >= 0.01), 0.9).otherwise(F.least(density, F.lit(0.5))).alias(name)
            )
        vector, raw, chance, label, flat, rate = (
            fresh(documents, n) for n in ("vector", "raw", "chance", "label_", "flat", "rate")
        )
        trees = self.trees.setFeaturesCol(vector).setRawPredictionCol(raw).setProbabilityCol(chance).setPredictionCol(label)
        curve = self.curve.setFeaturesCol(flat).setPredictionCol(rate)
        scored = trees.transform(found.withColumn(vector, array_to_vector(feature)))
        scored = curve.transform(scored.withColumn(flat, vector_to_array(chance)[1]))
        # The curve is flat in places: a thousandth of the trees' own probability keeps their order.
        return scored.select(*documents.columns, (0.999 * F.col(rate) + 0.001 * F.col(flat)).alias(name))


def _features(df: DataFrame, lexicon: dict, beginnings: dict, text: str, name: str) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast((lexicon, beginnings))

    def kernel(texts: pa.Array) -> dict[str, list]:
        return {"values": [measure(t or "", *shared.value) for t in texts.to_pylist()]}

    inner = fresh(df, "measured")
    found = attach(df, [text], kernel, "values array<double>", inner)
    return found.select(*df.columns, F.col(f"{inner}.values").alias(name))


def held_out(doc_id: Column) -> Column:
    """Rows whose label is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Fit on ``documents`` (doc_id, text) that have a label in ``labels`` (doc_id, toxic) and are not held out."""
    chosen = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("double").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )
    sample = settle(  # at most sample_rows ids are broadcast
        documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(
            "doc_id", "toxic", F.coalesce("text", F.lit("")).alias("text")
        ),
        "toxicity-sample",
    )
    totals = {row.toxic: row.n for row in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = totals.get(1.0, 0), totals.get(0.0, 0)
    seeds = {word: 1.0 for word in SEEDS}
    if not toxic or not clean:
        return ToxicityModel(seeds, {}, None, None)
    lexicon, beginnings = _lexicon(sample, toxic, clean)
    lexicon = seeds | lexicon
    rows = settle(
        _features(sample, lexicon, beginnings, "text", "features")
        .select("toxic", array_to_vector("features").alias("vector"), (F.pmod(F.xxhash64("doc_id"), F.lit(10)) < 3).alias("late"))
        .repartition(6),
        "toxicity-features",
    )
    classes = {row.late: row.n for row in rows.groupBy("late").agg(F.countDistinct("toxic").alias("n")).collect()}
    split = classes.get(True, 0) == 2 and classes.get(False, 0) == 2
    early, late = (rows.where("not late"), rows.where("late")) if split else (rows, rows)
    trees = GBTClassifier(
        featuresCol="vector", labelCol="toxic", maxDepth=3, maxIter=20, stepSize=0.2, subsamplingRate=1.0, seed=7
    ).fit(early)
    chances = trees.transform(late).select("toxic", vector_to_array("probability")[1].alias("chance"))
    curve = IsotonicRegression(featuresCol="chance", labelCol="toxic").fit(chances)
    return ToxicityModel(lexicon, beginnings, trees, curve)


def _lexicon(sample: DataFrame, toxic: int, clean: int) -> tuple[dict[str, float], dict[str, float]]:
    """Telling words and beginnings of words, with the logarithm of their odds."""

    def kernel(texts: pa.Array) -> dict[str, list]:
        out = []
        for text in texts.to_pylist():
            found = set(words(text))
            out.append([*found, *{w[:BEGINNING] + "*" for w in found if len(w) > BEGINNING}])
        return {"terms": out}

    held = attach(sample, ["text"], kernel, "terms array<string>", "found", keep=["toxic"])
    counts = held.select("toxic", F.explode("found.terms").alias("term")).groupBy("term").agg(
        F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")
    )
    odds = ((F.col("bad") + 0.5) / (toxic + 1)) / ((F.col("good") + 0.5) / (clean + 1))
    telling = counts.where(F.col("bad") >= LEAST_DOCUMENTS).select("term", "bad", odds.alias("odds")).where(F.col("odds") >= LEAST_ODDS)
    out = []
    for kind in (~F.col("term").endswith("*"), F.col("term").endswith("*")):
        top = telling.where(kind).orderBy(F.desc("bad"), "term").limit(LEXICON_SIZE).collect()
        out.append({row.term.rstrip("*"): math.log(row.odds) for row in top})
    return out[0], out[1]


def report(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted.

    Repeated rows and rows without an id are scored like any other; a document without text has the
    score of an empty text. Without labels of both classes the score follows the seed words alone.
    """
    scored = fit(documents, labels).score(documents.select("doc_id", "text"), "score")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
