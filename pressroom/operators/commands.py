"""Batches of editorial commands as pure table changes: old table + commands → new table, outcomes.

Each command table carries a unique ``seq`` that gives the order of the commands.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from pressroom.functions.text import TOXIC_KEYWORDS
from pressroom.operators.dedupe import with_article_ids
from pressroom.operators.moderation import moderate, saved_sentiment
from pressroom.operators.ranking import first_per_key, with_rank
from pressroom.session import settle


class Change(NamedTuple):
    table: DataFrame
    outcomes: DataFrame


def review_articles(articles: DataFrame, commands: DataFrame) -> Change:
    """``approve``/``reject`` by article id. Only a pending article changes, so the first
    command of an article decides and later ones find nothing to do."""
    firsts = commands.groupBy("article_id").agg(
        F.min("seq").alias("_first"), F.min_by("action", "seq").alias("_action")
    )
    marked = articles.join(firsts, "article_id", "left")
    decides = (F.col("status") == "Pending") & F.col("_first").isNotNull()
    verdict = F.when(F.col("_action") == "approve", "published").otherwise("rejected")
    table = marked.withColumn("status", F.when(decides, verdict).otherwise(F.col("status")))
    first_rows = marked.filter(decides).select("article_id", "_first")
    outcomes = commands.join(first_rows, "article_id", "left").select(
        "seq",
        "article_id",
        "action",
        F.when(F.col("seq") == F.col("_first"), "applied").otherwise("not_found").alias("outcome"),
    )
    return Change(table.select(*articles.columns), outcomes)


def delete_rows(table: DataFrame, commands: DataFrame, key: str) -> Change:
    """Delete by id; the first command of an id succeeds. Dependent rows are not touched."""
    firsts = commands.groupBy(key).agg(F.min("seq").alias("_first"))
    present = table.select(key).join(firsts, key)
    outcomes = commands.join(present, key, "left").select(
        "seq", key, F.when(F.col("seq") == F.col("_first"), "deleted").otherwise("not_found").alias("outcome")
    )
    return Change(table.join(firsts, key, "left_anti"), outcomes)


def toggle_users(users: DataFrame, commands: DataFrame) -> Change:
    """Active ↔ Inactive, anything else → Active; only the parity of the commands matters."""
    counts = commands.groupBy("id").agg(F.count(F.lit(1)).alias("_n"))
    marked = users.join(counts, "id", "left")
    odd = F.col("_n") % 2 == 1
    after = F.when(F.col("status").eqNullSafe("Active") == odd, "Inactive").otherwise("Active")
    table = marked.withColumn(
        "status", F.when(F.col("_n").isNotNull(), after).otherwise(F.col("status"))
    ).select(*users.columns)
    known = users.select("id", F.lit(True).alias("_known")).distinct()
    outcomes = counts.join(known, "id", "left").select(
        "id",
        F.col("_n").alias("commands"),
        F.when(F.col("_known").isNull(), "not_found").otherwise("toggled").alias("outcome"),
    )
    return Change(table, outcomes)


def _settle_author_requests(users: DataFrame, commands: DataFrame, grant: bool) -> Change:
    firsts = commands.groupBy("id").agg(F.min("seq").alias("_first"))
    marked = users.join(firsts, "id", "left")
    hit = F.col("_first").isNotNull() & F.coalesce(F.col("author_requested"), F.lit(False))
    table = marked
    if grant:
        table = table.withColumn("role", F.when(hit, "author").otherwise(F.col("role")))
    table = table.withColumn("author_requested", F.when(hit, False).otherwise(F.col("author_requested")))
    known = marked.filter(F.col("_first").isNotNull()).select("id", "_first", hit.alias("_hit"))
    outcomes = commands.join(known, "id", "left").select(
        "seq",
        "id",
        F.when(F.col("_first").isNull(), "not_found")
        .when(F.col("_hit") & (F.col("seq") == F.col("_first")), "applied")
        .otherwise("no_request")
        .alias("outcome"),
    )
    return Change(table.select(*users.columns), outcomes)


def approve_author_requests(users: DataFrame, commands: DataFrame) -> Change:
    """Grant the author role to users with an open request."""
    return _settle_author_requests(users, commands, grant=True)


def clear_author_requests(users: DataFrame, commands: DataFrame) -> Change:
    """Drop open requests without a change of role."""
    return _settle_author_requests(users, commands, grant=False)


def request_author(users: DataFrame, commands: DataFrame) -> DataFrame:
    """Raise the author-request flag."""
    asked = commands.select("id").distinct().withColumn("_asked", F.lit(True))
    return (
        users.join(asked, "id", "left")
        .withColumn("author_requested", F.coalesce(F.col("_asked"), F.col("author_requested")))
        .select(*users.columns)
    )


def upsert_settings(settings: DataFrame, commands: DataFrame) -> DataFrame:
    """Last value per key wins over the stored one; new keys are added."""
    last = commands.groupBy("setting_key").agg(F.max_by("value", "seq").alias("_value"), F.lit(True).alias("_set"))
    joined = settings.join(last, "setting_key", "full_outer")
    value = F.when(F.col("_set"), F.col("_value")).otherwise(F.col("value"))
    return joined.select("setting_key", value.alias("value"))


def upsert_latest(stored: DataFrame, updates: DataFrame, key: str, order: str) -> DataFrame:
    """Keyed upsert of whole rows: the row with the greatest ``order`` per key is kept."""
    both = stored.unionByName(updates)
    packed = F.struct(*both.columns)
    return both.groupBy(key).agg(F.max_by(packed, order).alias("_row")).select("_row.*")


def register_users(users: DataFrame, requests: DataFrame, now: str) -> Change:
    """New users: terms accepted, e-mail not taken, first request of an e-mail wins.

    Expects ``seq, first_name, last_name, email, terms_accepted`` and optionally ``phone`` and
    ``newsletter``. Passwords do not enter.
    """
    asked = requests
    for column, default in (("phone", "CAST(NULL AS STRING)"), ("newsletter", "false")):
        if column not in asked.columns:
            asked = asked.withColumn(column, F.expr(default))
    agreed = F.coalesce(F.col("terms_accepted"), F.lit(False))
    firsts = first_per_key(asked.filter(agreed), ["email"], ["seq"])
    accepted = settle(firsts.join(users.select("email"), "email", "left_anti"), "accepted-users")
    last_id = users.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()[0]
    numbered = accepted.join(with_rank(accepted.select("seq"), ["seq"], "_n"), "seq")
    defaults = {
        "id": F.col("_n") + F.lit(last_id),
        "role": F.lit("User"),
        "status": F.lit("Active"),
        "registration_date": F.to_timestamp(F.lit(now)),
        "avatar_url": F.lit(None).cast("string"),
        "author_requested": F.lit(False),
    }
    added = numbered.select(*[defaults.get(column, F.col(column)).alias(column) for column in users.columns
                              if column in defaults or column in asked.columns])
    outcomes = asked.join(numbered.select("seq", F.lit(True).alias("_new")), "seq", "left").select(
        "seq",
        "email",
        F.when(~agreed, "terms_required").when(F.col("_new"), "registered").otherwise("email_taken").alias("outcome"),
    )
    return Change(users.unionByName(added, allowMissingColumns=True), outcomes)


def add_comments(
    comments: DataFrame,
    submissions: DataFrame,
    articles: DataFrame,
    users: DataFrame,
    scores: DataFrame,
    now: str,
    keywords: Sequence[str] = TOXIC_KEYWORDS,
) -> Change:
    """Insert moderated comments and replies.

    ``submissions``: ``seq, article_id, user_id, parent_id, content``; ``scores``: logits keyed by
    ``comment_id`` = ``seq``. A comment needs its user and article, a reply its user and parent.
    A comment whose text is empty is not saved; an empty reply is saved as neutral.
    """
    with_users = submissions.join(
        users.select(F.col("id").alias("user_id"), F.lit(True).alias("_user")).distinct(), "user_id", "left"
    )
    with_articles = with_users.join(
        articles.select("article_id", F.lit(True).alias("_article")).distinct(), "article_id", "left"
    )
    # Only replies look for a parent: a NULL key would gather all top-level comments in one place.
    is_reply = F.col("parent_id").isNotNull()
    parents = comments.select(F.col("id").alias("parent_id"), F.lit(True).alias("_parent")).distinct()
    replies = with_articles.filter(is_reply).join(parents, "parent_id", "left")
    tops = with_articles.filter(~is_reply).withColumn("_parent", F.lit(None).cast("boolean"))
    judged = moderate(replies.unionByName(tops), scores, keywords, key="seq")
    target = F.when(is_reply, F.col("_parent")).otherwise(F.col("_article"))
    outcome = (
        F.when(F.col("_user").isNull(), "no_user")
        .when(target.isNull(), F.when(is_reply, "no_parent").otherwise("no_article"))
        .when(F.col("decision") == "approve", "saved")
        .when(F.col("decision") == "reject", "rejected")
        .when(is_reply, "saved")
        .otherwise("ignored")
    )
    # Both results need the decisions; settled, the texts are cleaned once and not in a filter.
    decided = settle(judged.withColumn("outcome", outcome), "decided-comments")
    neutral = F.col("decision").isNull()
    last_id = comments.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()[0]
    kept = decided.filter("outcome = 'saved'")
    saved = kept.join(with_rank(kept.select("seq"), ["seq"], "_n"), "seq")
    stamp = F.to_timestamp(F.lit(now))
    values = {
        "id": F.col("_n") + F.lit(last_id),
        "created_at": stamp,
        "updated_at": stamp,
        "likes": F.lit(0).cast("bigint"),
        "status": F.lit("active"),
        "sentiment": F.when(neutral, "neutral").otherwise(saved_sentiment(F.col("label"))),
        "sentiment_confidence": F.when(neutral, 0.0).otherwise(F.col("confidence")),
    }
    added = saved.select(*[values.get(column, F.col(column)).alias(column) for column in comments.columns])
    return Change(comments.unionByName(added), decided.select("seq", "outcome", "label", "decision", "reason"))


def like_comments(comments: DataFrame, events: DataFrame) -> DataFrame:
    """One more like per event on an existing comment; events are counted before the join."""
    counts = events.groupBy(F.col("comment_id").alias("id")).agg(F.count(F.lit(1)).alias("_likes"))
    joined = comments.join(counts, "id", "left")
    likes = F.coalesce(F.col("likes"), F.lit(0)) + F.coalesce(F.col("_likes"), F.lit(0))
    keep = F.col("_likes").isNull()
    return joined.withColumn(
        "likes", F.when(keep, F.col("likes").cast("bigint")).otherwise(likes.cast("bigint"))
    ).select(*comments.columns)


def upload_articles(articles: DataFrame, uploads: DataFrame) -> DataFrame:
    """Append uploads under fresh ids, in ``seq`` order, with the status they came with."""
    ids = with_article_ids(uploads.select("seq"), articles, ["seq"])
    numbered = uploads.drop("article_id").join(ids, "seq")
    return articles.unionByName(numbered.select(*articles.columns))
