"""The stored tables as views over the test tables, for Spark and as SQL text for the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pressroom.operators.pages import ListingRule, SiteRule
from pressroom.session import pin


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return pin(spark).read.parquet(f"{folder}/{name}.parquet")


def articles(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    posted = F.timestamp_add("HOUR", F.col("doc_id").cast("int"), start)
    key = F.col("doc_id").cast("string")
    return docs.join(labels, "doc_id", "left").select(
        F.concat(F.lit("BB-"), (F.col("doc_id") + 1).cast("string")).alias("article_id"),
        F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 80).alias("title"),
        F.substring("text", 1, 200).alias("description"),
        F.col("text").alias("content"),
        F.when(F.col("doc_id") % 97 != 0, posted).alias("date_posted"),
        F.col("source").alias("author"),
        F.concat(F.lit("http://site/"), key).alias("source_url"),
        F.when(F.col("quality") == 1, "published")
        .when(F.col("quality") == 0, "rejected")
        .otherwise("Pending")
        .alias("status"),
        F.when(F.col("lang") == "en", "the-gioi")
        .when(F.col("lang") == "fr", "kinh-doanh")
        .when(F.col("lang") == "de", "The-Thao")
        .otherwise("doi-song")
        .alias("type"),
        F.when(F.col("doc_id") % 5 == 0, "")
        .when(F.col("doc_id") % 7 != 0, F.concat(F.lit("http://img/"), key, F.lit("a.jpg , http://img/b.jpg")))
        .alias("image_urls"),
        F.lit("").alias("video_urls"),
    )


def comments(spark: SparkSession, folder: str) -> DataFrame:
    talk = table(spark, folder, "conversations")
    start = F.lit("2024-02-01 00:00:00").cast("timestamp")
    minute = (F.col("conv_id") * 10 + F.col("turn")).cast("int")
    return talk.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("id"),
        F.concat(F.lit("BB-"), (F.col("conv_id") + 1).cast("string")).alias("article_id"),
        ((F.col("conv_id") * 37 + F.col("turn")) % 2000).alias("user_id"),
        F.col("text").alias("content"),
        F.timestamp_add("MINUTE", minute, start).alias("created_at"),
        F.when(F.col("turn") != 0, F.col("conv_id") * 100).alias("parent_id"),
        F.when(F.col("turn") % 3 != 2, F.col("turn")).alias("likes"),
        F.when((F.col("conv_id") + F.col("turn")) % 11 == 0, "hidden").otherwise("active").alias("status"),
    )


def users(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer")
    first = table(spark, folder, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_order"))
    return customers.join(first, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("first_name"),
        F.col("c_mktsegment").alias("last_name"),
        F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
        F.when(F.col("c_nationkey") == 0, "admin")
        .when(F.col("c_nationkey") < 5, "author")
        .otherwise("User")
        .alias("role"),
        F.when(F.col("c_acctbal") < 0, "Inactive").otherwise("Active").alias("status"),
        F.col("first_order").alias("registration_date"),
        (F.col("c_custkey") % 13 == 0).alias("author_requested"),
    )


def scores(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    logits = [
        (20 * F.col("embedding")[i].cast("double")).alias(f"logit_{i}") for i in range(3)
    ]
    # Some comments have no score.
    ids = comments(spark, folder).select(F.col("id").alias("comment_id")).filter("comment_id % 19 <> 3")
    rows = vectors.count()  # every vector can be met, whatever the size of the table
    return ids.join(vectors, F.col("vec_id") == F.col("comment_id") % F.lit(rows)).select("comment_id", *logits)


def verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts on comments; most of them name a comment that does not exist."""
    labels = table(spark, folder, "labels")
    return labels.select(F.col("doc_id").alias("comment_id"), (F.col("toxic") * 2).alias("label"))


def page_sites() -> dict[str, SiteRule]:
    """Rules for the hosts of the ``pages`` table; hosts outside the list are dropped."""
    listed = ListingRule(
        containers=("nav",), item="li", links=(("a",),), base="https://example.test", prefix="http"
    )
    unique = ListingRule(**{**listed.__dict__, "unique_urls": True})
    early = ListingRule(**{**listed.__dict__, "limit_before_filter": True, "unique_urls": True})
    common = {
        "title": (("h1",),),
        "description": (("div.ad",),),
        "body": "article",
        "author": (("footer",),),
    }
    return {
        "blog": SiteRule(host="//blog.", listing=unique, **common),
        "www": SiteRule(host="//www.", listing=early, **common),
        "com": SiteRule(host="example.com", listing=listed, **common),
        "net": SiteRule(host="example.net", listing=listed, figures="photo", needs_text=True, **common),
    }


# The same views as SQL, for the side-by-side checks.
ARTICLES_SQL = """articles AS (
  SELECT concat('BB-', CAST(d.doc_id + 1 AS VARCHAR)) AS article_id,
         substring(split_part(d.text, chr(10), 1), 1, 80) AS title,
         substring(d.text, 1, 200) AS description,
         d.text AS content,
         CASE WHEN d.doc_id % 97 = 0 THEN NULL
              ELSE TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(d.doc_id AS INT)) END AS date_posted,
         d.source AS author,
         concat('http://site/', CAST(d.doc_id AS VARCHAR)) AS source_url,
         CASE WHEN l.quality = 1 THEN 'published' WHEN l.quality = 0 THEN 'rejected'
              ELSE 'Pending' END AS status,
         CASE d.lang WHEN 'en' THEN 'the-gioi' WHEN 'fr' THEN 'kinh-doanh'
              WHEN 'de' THEN 'The-Thao' ELSE 'doi-song' END AS type,
         CASE WHEN d.doc_id % 5 = 0 THEN '' WHEN d.doc_id % 7 = 0 THEN NULL
              ELSE concat('http://img/', CAST(d.doc_id AS VARCHAR), 'a.jpg , http://img/b.jpg')
         END AS image_urls,
         '' AS video_urls
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""

COMMENTS_SQL = """comments AS (
  SELECT conv_id * 100 + turn AS id,
         concat('BB-', CAST(conv_id + 1 AS VARCHAR)) AS article_id,
         (conv_id * 37 + turn) % 2000 AS user_id,
         text AS content,
         TIMESTAMP '2024-02-01 00:00:00' + to_minutes(CAST(conv_id * 10 + turn AS INT)) AS created_at,
         CASE WHEN turn = 0 THEN NULL ELSE conv_id * 100 END AS parent_id,
         CASE WHEN turn % 3 = 2 THEN NULL ELSE turn END AS likes,
         CASE WHEN (conv_id + turn) % 11 = 0 THEN 'hidden' ELSE 'active' END AS status
  FROM conversations)"""

USERS_SQL = """users AS (
  SELECT c.c_custkey AS id, c.c_name AS first_name, c.c_mktsegment AS last_name,
         concat(lower(c.c_name), '@example.com') AS email,
         CASE WHEN c.c_nationkey = 0 THEN 'admin' WHEN c.c_nationkey < 5 THEN 'author'
              ELSE 'User' END AS role,
         CASE WHEN c.c_acctbal < 0 THEN 'Inactive' ELSE 'Active' END AS status,
         o.first_order AS registration_date,
         c.c_custkey % 13 = 0 AS author_requested
  FROM customer c
  LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS first_order FROM orders GROUP BY o_custkey) o
         ON o.o_custkey = c.c_custkey)"""

SCORES_SQL = """scores AS (
  SELECT c.id AS comment_id,
         20 * CAST(e.embedding[1] AS DOUBLE) AS logit_0,
         20 * CAST(e.embedding[2] AS DOUBLE) AS logit_1,
         20 * CAST(e.embedding[3] AS DOUBLE) AS logit_2
  FROM comments c JOIN embeddings e ON e.vec_id = c.id % (SELECT count(*) FROM embeddings)
  WHERE c.id % 19 <> 3)"""

VERDICTS_SQL = """verdicts AS (
  SELECT doc_id AS comment_id, toxic * 2 AS label FROM labels)"""

VIEWS_SQL = {
    "articles": ARTICLES_SQL,
    "comments": COMMENTS_SQL,
    "users": USERS_SQL,
    "scores": SCORES_SQL,
    "verdicts": VERDICTS_SQL,
}

