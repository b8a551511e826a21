"""Comment moderation: model scores → decision, verdict batches, sentiment."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from pressroom.functions.text import (
    TOXIC_KEYWORDS,
    has_keyword,
    moderation_text,
    sentiment_text,
    snippet,
    snippet_if_longer,
    strip,
)
from pressroom.operators import topics
from pressroom.session import ship, spread

# Decision texts, label descriptions and constants of the moderation rules.
APPROVE, REJECT = "approve", "reject"
REASON_KEYWORD = "Bình luận chứa từ ngữ không phù hợp"
REASON_POSITIVE = "Bình luận tích cực (Label 0)"
REASON_NEGATIVE = "Bình luận tiêu cực/độc hại (Label {})"
REASON_UNSURE = "Độ tin cậy thấp ({})"
REASON_NO_MODEL = "PhoBERT model không khả dụng"
DESCRIPTIONS = ("Bình luận tích cực/an toàn", "Bình luận tiêu cực nhẹ", "Bình luận độc hại/spam")
DESCRIPTION_EMPTY = "Văn bản trống"
DESCRIPTION_EMPTY_AFTER = "Văn bản trống sau xử lý"
DESCRIPTION_NO_MODEL = "Model chưa được load"
APPROVE_ABOVE = 0.7
SAVED_CONFIDENCE = 0.9

SCORE_COLUMNS = ("logit_0", "logit_1", "logit_2")


def with_probabilities(scores: DataFrame, logits: Sequence[str] = SCORE_COLUMNS) -> DataFrame:
    """Softmax and argmax of the logits, in built-in array expressions."""
    values = F.array(*[F.col(name).cast("double") for name in logits])
    top = F.array_max("_logits")
    total = F.aggregate("_powers", F.lit(0.0), lambda acc, x: acc + x)
    return (
        scores.withColumn("_logits", values)
        .withColumn("_powers", F.transform("_logits", lambda x: F.exp(x - top)))
        .withColumn("probabilities", F.transform("_powers", lambda x: x / total))
        .withColumn("label", (F.array_position("_logits", top) - 1).cast("int"))
        .withColumn("confidence", F.array_max("probabilities"))
        .drop("_logits", "_powers")
    )


def decide(
    scored: DataFrame,
    text: str = "content",
    keywords: Sequence[str] = TOXIC_KEYWORDS,
    model_missing: str = REJECT,
) -> DataFrame:
    """Label, confidence, decision and reason of each comment.

    Expects ``label`` and ``confidence``, NULL where the model gave no score. The order of the
    rules matters: empty text (never scored, no decision), no model, keyword, sure positive, negative,
    unsure. ``model_missing='none'`` gives the batch form: label 1 and no decision.
    """
    clean = moderation_text(F.col(text))
    empty_text = F.length(strip(F.coalesce(F.col(text), F.lit("")))) == 0
    empty = F.col("_clean") == ""
    missing = F.col("_label").isNull()
    toxic = has_keyword(F.col("_clean"), keywords)
    positive = (F.col("_label") == 0) & (F.col("_confidence") > APPROVE_ABOVE)
    negative = F.col("_label").isin(1, 2)
    single = model_missing == REJECT
    none = F.lit(None).cast("string")
    base = (
        scored.withColumnRenamed("label", "_label")
        .withColumnRenamed("confidence", "_confidence")
        .withColumn("_clean", clean)
    )
    return base.select(
        *[name for name in scored.columns if name not in ("label", "confidence")],
        F.when(empty, 0).when(missing, F.lit(2 if single else 1)).otherwise(F.col("_label")).cast("int").alias("label"),
        F.when(empty, 0.5).when(missing, 0.0).otherwise(F.col("_confidence")).alias("confidence"),
        F.when(empty_text, DESCRIPTION_EMPTY)
        .when(empty, DESCRIPTION_EMPTY_AFTER)
        .when(missing, F.lit(DESCRIPTION_NO_MODEL if single else None))
        .otherwise(F.element_at(F.array(*[F.lit(d) for d in DESCRIPTIONS]), F.col("_label") + 1))
        .alias("description"),
        F.when(empty, none)
        .when(missing, F.lit(REJECT) if single else none)
        .when(toxic, REJECT)
        .when(positive, APPROVE)
        .otherwise(REJECT)
        .alias("decision"),
        F.when(empty, none)
        .when(missing, F.lit(REASON_NO_MODEL) if single else none)
        .when(toxic, REASON_KEYWORD)
        .when(positive, REASON_POSITIVE)
        .when(negative, F.replace(F.lit(REASON_NEGATIVE), F.lit("{}"), F.col("_label").cast("string")))
        .otherwise(F.replace(F.lit(REASON_UNSURE), F.lit("{}"), F.format_string("%.2f", "_confidence")))
        .alias("reason"),
        snippet_if_longer(F.col("_clean")).alias("processed_text"),
    )


def moderate(
    comments: DataFrame,
    scores: DataFrame,
    keywords: Sequence[str] = TOXIC_KEYWORDS,
    key: str = "id",
    model_missing: str = REJECT,
) -> DataFrame:
    """Decision per comment from a table of logits keyed by ``comment_id``."""
    rated = with_probabilities(scores).select(
        F.col("comment_id").alias("_cid"), "label", "confidence", "probabilities"
    )
    joined = spread(comments).join(rated, F.col(key) == F.col("_cid"), "left").drop("_cid")
    return decide(joined, "content", keywords, model_missing)


Scorer = Callable[[pd.Series], pd.DataFrame]


def score_with(comments: DataFrame, scorer: Scorer, key: str = "id", text: str = "content") -> DataFrame:
    """Logits from a user-supplied model, called once per Arrow batch of cleaned texts.

    ``scorer`` maps a series of texts to a frame with the columns of ``SCORE_COLUMNS``.
    """
    ship(comments.sparkSession)
    id_type = comments.schema[key].dataType.simpleString()
    schema = f"comment_id {id_type}, " + ", ".join(f"{name} double" for name in SCORE_COLUMNS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            logits = scorer(batch["text"])[list(SCORE_COLUMNS)].reset_index(drop=True)
            yield pd.concat([batch["comment_id"].reset_index(drop=True), logits], axis=1)

    ready = comments.select(F.col(key).alias("comment_id"), moderation_text(F.col(text)).alias("text"))
    return ready.filter("text <> ''").mapInPandas(run, schema)  # an empty text is decided without a score


def saved_sentiment(label: Column) -> Column:
    return F.when(label == 0, "positive").otherwise("negative")


@dataclass(frozen=True)
class VerdictOutcome:
    rows: DataFrame  # every verdict with its outcome, repeats kept
    saved: DataFrame
    deleted: DataFrame
    new_comments: DataFrame
    pending: DataFrame  # the pending table after the batch


# Fixed value: the status of a pending comment that has its verdict.
PROCESSED = "processed"


def apply_verdicts(
    verdicts: DataFrame, pending: DataFrame, articles: DataFrame | None = None, now: Column | None = None
) -> VerdictOutcome:
    """Labels 0 and 1 save, 2 deletes, others only mark; unknown comments are errors.

    A saved comment whose article is gone is an error too, when ``articles`` is given. In the pending
    table after the batch every comment with a verdict that is no error is processed at ``now``; of
    several verdicts on a comment the largest label is shown.
    """
    known = pending.withColumn("_known", F.lit(True))
    joined = verdicts.join(known, "comment_id", "left")
    saves = F.col("label").isin(0, 1)
    outcome = F.when(F.col("_known").isNull(), "error")
    if articles is not None:
        present = articles.select("article_id").distinct().withColumn("_article", F.lit(True))
        joined = joined.join(present, "article_id", "left")
        outcome = outcome.when(saves & F.col("_article").isNull(), "error")
    outcome = outcome.when(saves, "saved").when(F.col("label") == 2, "deleted").otherwise("processed")
    rows = joined.withColumn("outcome", outcome)
    saved, deleted = rows.filter("outcome = 'saved'"), rows.filter("outcome = 'deleted'")
    brief = snippet(F.col("content")).alias("content")
    done = rows.filter("outcome <> 'error'").groupBy("comment_id").agg(F.max("label").cast("int").alias("_done_label"))
    marked = pending.join(done, "comment_id", "left")
    hit = F.col("_done_label").isNotNull()
    after = {
        "status": F.when(hit, PROCESSED),
        "phobert_label": F.col("_done_label"),
        "processed_at": F.when(hit, F.current_timestamp() if now is None else now),
    }
    for name, value in after.items():
        marked = marked.withColumn(name, F.coalesce(value, F.col(name)) if name in pending.columns else value)
    return VerdictOutcome(
        rows.select("comment_id", "label", "outcome"),
        saved.select("comment_id", brief, "label"),
        deleted.select("comment_id", brief, F.lit("Label 2 - Content filtered").alias("reason")),
        saved.select(
            "article_id",
            "user_id",
            "content",
            "parent_id",
            saved_sentiment(F.col("label")).alias("sentiment"),
            F.lit(SAVED_CONFIDENCE).alias("sentiment_confidence"),
        ),
        marked.drop("_done_label"),
    )


def verdict_statistics(outcome_rows: DataFrame) -> DataFrame:
    return outcome_rows.agg(
        F.count(F.lit(1)).alias("total_processed"),
        F.count_if(F.col("outcome") == "saved").alias("saved_to_db"),
        F.count_if(F.col("outcome") == "deleted").alias("deleted"),
        F.count_if(F.col("outcome") == "error").alias("errors"),
    )


def status_counts(pending: DataFrame) -> DataFrame:
    return pending.groupBy("status").agg(F.count(F.lit(1)).alias("comments"))


def sentiment(
    comments: DataFrame, model: topics.TopicModel, key: str = "id", text: str = "content"
) -> DataFrame:
    """Sentiment label and confidence; a text that is empty after cleaning is neutral, 0.0."""
    cleaned = spread(comments.select(key, text)).select(key, sentiment_text(F.col(text)).alias("_text"))
    # The short text rides along as a key of the score aggregation: one pass, one shuffle, no join.
    shown = cleaned.withColumn("processed_text", snippet_if_longer(F.col("_text")))
    rated = topics.classify(shown, "_text", (key, "processed_text"), model)
    empty = F.col("processed_text") == ""
    return rated.select(
        key,
        F.when(empty, "neutral").otherwise(F.col("predicted")).alias("sentiment"),
        F.when(empty, 0.0).otherwise(F.col("confidence")).alias("confidence"),
        F.when(~empty, F.col("processed_text")).alias("processed_text"),
    )


SENTIMENTS = ("positive", "negative", "neutral")


def sentiment_statistics(rated: DataFrame, column: str = "sentiment") -> DataFrame:
    """Counts and percentages, halves rounded to even; an empty input gives zero counts."""
    counts = rated.agg(
        *[F.count_if(F.col(column) == name).alias(name) for name in SENTIMENTS],
        F.count(F.lit(1)).alias("total"),
    )
    return counts.select(
        "*",
        *[
            F.bround(F.try_divide(100 * F.col(name), F.col("total")), 1).alias(f"{name}_percent")
            for name in SENTIMENTS
        ],
    )
