"""Comment export, author names, threads and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pressroom.functions.dates import epoch_seconds
from pressroom.functions.display import display_name
from pressroom.functions.text import clean_comment
from pressroom.operators.catalogue import newest_first, page
from pressroom.operators.ranking import with_rank
from pressroom.session import settle

COMMENTS_PER_PAGE = 10


def active(comments: DataFrame) -> DataFrame:
    return comments.filter(F.col("status") == "active")


def roots(comments: DataFrame) -> DataFrame:
    return comments.filter(F.col("parent_id").isNull())


def export_rows(comments: DataFrame, articles: DataFrame) -> DataFrame:
    """Every comment with its cleaned text and its article's title and type, if it has one."""
    about = articles.select("article_id", F.col("title").alias("article_title"), F.col("type").alias("article_type"))
    return comments.join(about, "article_id", "left").select(
        "id",
        "content",
        clean_comment(F.col("content")).alias("cleaned_content"),
        "user_id",
        "article_id",
        "article_title",
        "article_type",
        F.col("parent_id").isNotNull().alias("is_reply"),
        "parent_id",
        "created_at",
        epoch_seconds(F.col("created_at")).alias("timestamp"),
    )


def with_author_names(comments: DataFrame, users: DataFrame) -> DataFrame:
    """Display name of each comment's user; likes default to zero."""
    names = users.select(F.col("id").alias("_uid"), "first_name", "last_name")
    joined = comments.join(names, F.col("user_id") == F.col("_uid"), "left")
    return joined.select(
        *[column for column in comments.columns if column != "likes"],
        display_name(F.col("_uid"), F.col("first_name"), F.col("last_name")).alias("user_name"),
        F.coalesce(F.col("likes"), F.lit(0)).cast("bigint").alias("likes"),
    )


def threads(comments: DataFrame) -> DataFrame:
    """Active top-level comments and their active direct replies, as flat rows in reading order.

    Flat on purpose: a busy comment's replies would not fit one nested row. The replies are the
    left side of an inner join on a unique key, so a hot parent is split by the skew join.
    """
    live = active(comments)
    tops = roots(live)
    parents = tops.select(F.col("id").alias("root_id"), F.col("created_at").alias("root_created_at"))
    replies = live.filter(F.col("parent_id").isNotNull())
    answered = replies.join(parents, F.col("parent_id") == F.col("root_id"))
    own = tops.withColumn("root_id", F.col("id")).withColumn("root_created_at", F.col("created_at"))
    rows = own.unionByName(answered)
    return rows.withColumn("is_reply", F.col("parent_id").isNotNull()).orderBy(
        *newest_first("root_created_at", "root_id"), "is_reply", "created_at", "id"
    )


def thread_page(
    comments: DataFrame, article_id: str, number: int = 1, size: int = COMMENTS_PER_PAGE, users: DataFrame | None = None
) -> DataFrame:
    """One page of an article's top-level comments, newest first, each with all its replies, oldest first.

    ``position`` gives the reading order. With ``users`` every line carries its user's name.
    """
    live = active(comments)
    mine = roots(live).filter(F.col("article_id") == article_id)
    shown = page(mine, number, size, "created_at", "id")
    tops = settle(shown, "thread-roots")
    parents = tops.select(F.col("id").alias("parent_id"), F.col("created_at").alias("root_created_at"))
    replies = live.join(F.broadcast(parents), "parent_id")  # at most ``size`` rows
    own = tops.withColumn("root_created_at", F.col("created_at"))
    lines = settle(own.unionByName(replies.select(*own.columns)), "thread-lines")
    order = lines.select(
        "id", "root_created_at", F.coalesce("parent_id", "id").alias("root_id"), F.col("parent_id").isNotNull().alias("is_reply"), "created_at"
    )
    ranked = with_rank(order, [*newest_first("root_created_at", "root_id"), "is_reply", "created_at", "id"], "position")
    named = with_author_names(lines, users) if users is not None else lines
    return named.drop("root_created_at").join(ranked.select("id", "position"), "id").orderBy("position")


def counters(comments: DataFrame) -> DataFrame:
    """Active and total comments per article, replies included."""
    return comments.groupBy("article_id").agg(
        F.count_if(F.col("status") == "active").alias("active_comment_count"),
        F.count(F.lit(1)).alias("total_comment_count"),
    )


def root_and_reply_counts(comments: DataFrame) -> DataFrame:
    return comments.agg(
        F.count_if(F.col("parent_id").isNull()).alias("roots"),
        F.count_if(F.col("parent_id").isNotNull()).alias("replies"),
        F.count(F.lit(1)).alias("total"),
    )
