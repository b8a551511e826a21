"""Quality classifier by co-training of a text view and a metadata view.

Two logistic regressions start from the same labelled documents: one sees measures of the text, the other
language, source and length. In every round each labels the unlabelled documents it is sure of, and the
other learns from these too. At the end each view's logit is calibrated on labelled rows that were set
aside, and a third regression weighs the two.

Of the labelled documents a bounded sample is used (``SAMPLE_ROWS``, the first in the order of a hash of the
id); all documents without a label take part in the exchange. Scoring is one pass over all documents
without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import FeatureHasher
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressroom.llm.common import attach, fresh, settle

SAMPLE_ROWS = 10_000
ROUNDS = 3
SURE = 0.95
HASHES = 256
_WORD = re.compile(r"[^\W\d_]+")


def measure(text: str) -> list[float]:
    """Dense measures of a text; an empty text gives zeros."""
    words = _WORD.findall(text)
    lines = [line for line in text.split("\n") if line.strip()]
    n, length = max(1, len(words)), max(1, len(text))
    lower = [w.lower() for w in words]
    counts = Counter(lower)
    repeated = sum(c - 1 for c in Counter(lines).values())
    same = sum(a == b for a, b in zip(lower, lower[1:]))
    upper = sum(map(str.isupper, text)) if not text.islower() else 0
    digits = sum(map(str.isdigit, text))
    marks = sum(text.count(c) for c in "#$%&*@^~|<>{}[]=_\\")
    letters = sum(map(len, words))
    return [
        math.log1p(len(words)), letters / n, len(counts) / n, max(counts.values(), default=0) / n,
        repeated / max(1, len(lines)), same / n, upper / length, digits / length, marks / length, letters / length,
        text.count("!") / n, text.count("?") / n, (text.count(".") + text.count(",")) / n,
        sum(c for w, c in counts.items() if len(w) <= 3) / n, math.log1p(n / max(1, len(lines))),
        float(not words), math.sqrt(marks / length), math.sqrt(same / n), math.sqrt(text.count("!") / n),
        math.log1p(len(words)) ** 2,
    ]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _views(documents: DataFrame, text_view: str, meta_view: str) -> DataFrame:
    """``documents`` with the two feature vectors. Missing metadata is a value of its own."""

    def kernel(texts: pa.Array) -> dict[str, list]:
        return {"values": [measure(t or "") for t in texts.to_pylist()]}

    name = fresh(documents, "measured")
    found = attach(documents, ["text"], kernel, "values array<double>", name)
    columns = {c.lower() for c in documents.columns}
    meta = [fresh(found, f"meta_{c}") for c in ("lang", "source", "length")]
    for column, target in zip(("lang", "source"), meta):
        value = F.coalesce(F.col(column).cast("string"), F.lit("")) if column in columns else F.lit("")
        found = found.withColumn(target, value)
    found = found.withColumn(meta[2], F.log1p(F.coalesce(F.length("text"), F.lit(0)).cast("double")))
    hashed = FeatureHasher(inputCols=meta, outputCol=meta_view, numFeatures=HASHES).transform(found)
    return hashed.withColumn(text_view, array_to_vector(f"{name}.values")).select(*documents.columns, text_view, meta_view)


def _chance(df: DataFrame, model: LogisticRegressionModel, view: str, name: str) -> DataFrame:
    """``df`` with the probability of label 1 under the names the caller chose."""
    raw, chance, label = (fresh(df, f"{name}_{n}") for n in ("raw", "chance", "label"))
    model = model.setFeaturesCol(view).setRawPredictionCol(raw).setProbabilityCol(chance).setPredictionCol(label)
    return model.transform(df).withColumn(name, vector_to_array(chance)[1]).drop(raw, chance, label)


@dataclass
class QualityModel:
    """``constant`` is set if the labels do not hold both classes."""

    text: LogisticRegressionModel | None
    meta: LogisticRegressionModel | None
    mix: LogisticRegressionModel | None
    constant: float | None

    def score(self, documents: DataFrame, name: str) -> DataFrame:
        if self.constant is not None:
            return documents.withColumn(name, F.lit(self.constant))
        views = [fresh(documents, v) for v in ("text_view", "meta_view")]
        found = _views(documents, *views)
        return self._mixed(found, *views, name).select(*documents.columns, name)

    def _logits(self, found: DataFrame, text_view: str, meta_view: str, target: str) -> DataFrame:
        chances = [fresh(found, n) for n in ("chance_text", "chance_meta")]
        for model, view, chance in zip((self.text, self.meta), (text_view, meta_view), chances):
            found = _chance(found, model, view, chance)
        inner = [F.least(F.greatest(F.col(c), F.lit(1e-6)), F.lit(1 - 1e-6)) for c in chances]
        return found.withColumn(target, array_to_vector(F.array(*[F.log(p / (1 - p)) for p in inner]))).drop(*chances)

    def _mixed(self, found: DataFrame, text_view: str, meta_view: str, name: str) -> DataFrame:
        logits = fresh(found, "logits")
        return _chance(self._logits(found, text_view, meta_view, logits), self.mix, logits, name)


def _first(ids: DataFrame, rows: int) -> DataFrame:
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def fit(documents: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> QualityModel:
    """``documents``: doc_id, text, and lang and source if they exist; ``labels``: doc_id, quality (0 or 1)."""
    known = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("quality").cast("double").alias("label"))
    )
    labelled = _first(known.where(~held_out(F.col("doc_id"))), SAMPLE_ROWS)
    columns = [c for c in documents.columns if c.lower() in ("doc_id", "text", "lang", "source")]
    # Texts stay where they are; only the views of a document meet its label. The sample is bounded.
    viewed = _views(documents.select(*columns).where("doc_id is not null"), "text_view", "meta_view")
    viewed = settle(viewed.select("doc_id", "text_view", "meta_view"), "quality-views")
    sample = viewed.join(F.broadcast(labelled), "doc_id")
    pool = viewed.join(known, "doc_id", "left_anti").withColumn("label", F.lit(None).cast("double"))
    rows = sample.unionByName(pool)
    aside = F.col("label").isNotNull() & (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(10)) < 3)
    rows = settle(
        rows.select("*", aside.alias("aside")).withColumns({v: F.when(~F.col("aside"), F.col("label")) for v in ("for_text", "for_meta")}),
        "quality-sample",
    )
    kinds = rows.where("label is not null").groupBy("aside").agg(
        F.countDistinct("label").alias("kinds"), F.sum("label").alias("good"), F.count("*").alias("n")
    ).collect()
    if len(kinds) < 2 or any(k.kinds < 2 for k in kinds):
        good, n = sum(k.good for k in kinds), sum(k.n for k in kinds)
        return QualityModel(None, None, None, (good + 1) / (n + 2))
    learner = LogisticRegression(maxIter=30, regParam=1e-3)
    text = meta = None
    for number in range(rounds):
        text = learner.copy({learner.featuresCol: "text_view", learner.labelCol: "for_text"}).fit(rows.where("for_text is not null"))
        meta = learner.copy({learner.featuresCol: "meta_view", learner.labelCol: "for_meta"}).fit(rows.where("for_meta is not null"))
        if number == rounds - 1:
            break
        told = _chance(_chance(rows, text, "text_view", "by_text"), meta, "meta_view", "by_meta")
        sure = lambda p: F.when(F.col(p) >= SURE, 1.0).when(F.col(p) <= 1 - SURE, 0.0)
        told = told.withColumns({
            "for_text": F.when(F.col("aside"), None).otherwise(F.coalesce("for_text", sure("by_meta"))),
            "for_meta": F.when(F.col("aside"), None).otherwise(F.coalesce("for_meta", sure("by_text"))),
        })
        rows = settle(told.drop("by_text", "by_meta"), "quality-round")
    model = QualityModel(text, meta, None, None)
    calibration = model._logits(rows.where("aside"), "text_view", "meta_view", "logits")
    model.mix = LogisticRegression(featuresCol="logits", labelCol="label", maxIter=30, regParam=1e-4).fit(calibration)
    return model


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1, higher is better), predicted (score of 0.5 or more).

    Empty and NULL texts, rows without an id and repeated rows are scored like any other.
    """
    scored = fit(documents, labels).score(documents, name := fresh(documents, "score"))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col(name).alias("score"), (F.col(name) >= 0.5).cast("int").alias("predicted")
    )
