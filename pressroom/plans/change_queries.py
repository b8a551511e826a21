"""Queries over command batches and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressroom.functions import dates
from pressroom.operators import catalogue, commands
from pressroom.plans.catalogue_queries import SIGNUPS_SQL, _signups
from pressroom.plans.registry import query
from pressroom.plans.text_queries import DECIDED_SQL, KEYWORDS
from pressroom.session import shared_path
from pressroom.sources import fixtures as fx, tables
from pressroom.sources.keyed_table import KeyedTable
from pressroom.streaming import comments as streams

NOW = "2024-07-01 00:00:00"

REVIEW_SQL = """cmd AS (SELECT event_id AS seq, 'BB-' || CAST(user_id + 1 AS VARCHAR) AS article_id,
     CASE WHEN event_type IN ('view', 'purchase') THEN 'approve' ELSE 'reject' END AS action FROM events),
   firsts AS (SELECT article_id, min(seq) AS first, arg_min(action, seq) AS action FROM cmd GROUP BY article_id)"""


def _review(spark, folder):
    events = fx.table(spark, folder, "events").select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("BB-"), (F.col("user_id") + 1).cast("string")).alias("article_id"),
        F.when(F.col("event_type").isin("view", "purchase"), "approve").otherwise("reject").alias("action"),
    )
    return commands.review_articles(fx.articles(spark, folder), events)


@query(
    "m1_review_articles",
    f"""WITH {REVIEW_SQL} SELECT a.article_id, a.title,
          CASE WHEN a.status = 'Pending' AND f.action = 'approve' THEN 'published'
               WHEN a.status = 'Pending' AND f.action = 'reject' THEN 'rejected' ELSE a.status END AS status
        FROM articles a LEFT JOIN firsts f ON f.article_id = a.article_id""",
    "articles",
)
def m1(spark, folder):
    return _review(spark, folder).table.select("article_id", "title", "status")


@query(
    "m1_review_outcomes",
    f"""WITH {REVIEW_SQL} SELECT c.seq, c.article_id, c.action,
          CASE WHEN a.status = 'Pending' AND c.seq = f.first THEN 'applied' ELSE 'not_found' END AS outcome
        FROM cmd c LEFT JOIN articles a ON a.article_id = c.article_id JOIN firsts f ON f.article_id = c.article_id""",
    "articles",
)
def m1_outcomes(spark, folder):
    return _review(spark, folder).outcomes


def _deletions(spark, folder):
    events = fx.table(spark, folder, "events").filter("event_type = 'error'")
    return events.select(F.col("event_id").alias("seq"), F.col("user_id").alias("id"))


@query(
    "m2_delete_articles",
    """SELECT article_id, status FROM articles WHERE article_id NOT IN
       (SELECT 'BB-' || CAST(user_id + 1 AS VARCHAR) FROM events WHERE event_type = 'error')""",
    "articles",
)
def m2(spark, folder):
    asked = _deletions(spark, folder).select(
        "seq", F.concat(F.lit("BB-"), (F.col("id") + 1).cast("string")).alias("article_id")
    )
    return commands.delete_rows(fx.articles(spark, folder), asked, "article_id").table.select("article_id", "status")


@query(
    "m2_delete_user_outcomes",
    """SELECT e.event_id AS seq, e.user_id AS id, CASE WHEN u.id IS NOT NULL AND
         e.event_id = min(e.event_id) OVER (PARTITION BY e.user_id) THEN 'deleted' ELSE 'not_found' END AS outcome
       FROM events e LEFT JOIN users u ON u.id = e.user_id WHERE e.event_type = 'error'""",
    "users",
)
def m2_users(spark, folder):
    return commands.delete_rows(fx.users(spark, folder), _deletions(spark, folder), "id").outcomes


def _user_commands(spark, folder, *types):
    events = fx.table(spark, folder, "events").filter(F.col("event_type").isin(*types))
    return events.select(F.col("event_id").alias("seq"), F.col("user_id").alias("id"))


@query(
    "m3_toggle_users",
    """SELECT u.id, CASE WHEN coalesce(n, 0) % 2 = 0 THEN status WHEN status = 'Active' THEN 'Inactive' ELSE 'Active' END AS status
       FROM users u LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) e ON e.user_id = u.id""",
    "users",
)
def m3(spark, folder):
    asked = _user_commands(spark, folder, "view", "signup", "purchase", "error", "click")
    return commands.toggle_users(fx.users(spark, folder), asked).table.select("id", "status")


AUTHOR_SQL = "u.id IN (SELECT user_id FROM events WHERE event_type = '{}') AND u.author_requested"


@query(
    "m4_approve_authors",
    f"""SELECT u.id, CASE WHEN {AUTHOR_SQL.format('purchase')} THEN 'author' ELSE u.role END AS role,
               u.author_requested AND NOT ({AUTHOR_SQL.format('purchase')}) AS author_requested FROM users u""",
    "users",
)
def m4(spark, folder):
    change = commands.approve_author_requests(fx.users(spark, folder), _user_commands(spark, folder, "purchase"))
    return change.table.select("id", "role", "author_requested")


@query(
    "m4_approval_outcomes",
    """SELECT e.event_id AS seq, e.user_id AS id, CASE WHEN u.id IS NULL THEN 'not_found'
         WHEN u.author_requested AND e.event_id = min(e.event_id) OVER (PARTITION BY e.user_id) THEN 'applied'
         ELSE 'no_request' END AS outcome
       FROM events e LEFT JOIN users u ON u.id = e.user_id WHERE e.event_type = 'purchase'""",
    "users",
)
def m4_outcomes(spark, folder):
    return commands.approve_author_requests(fx.users(spark, folder), _user_commands(spark, folder, "purchase")).outcomes


@query(
    "m5_clear_requests",
    f"SELECT u.id, u.role, u.author_requested AND NOT ({AUTHOR_SQL.format('error')}) AS author_requested FROM users u",
    "users",
)
def m5(spark, folder):
    change = commands.clear_author_requests(fx.users(spark, folder), _user_commands(spark, folder, "error"))
    return change.table.select("id", "role", "author_requested")


@query(
    "m6_request_author",
    """SELECT id, author_requested OR id IN (SELECT user_id FROM events WHERE event_type = 'signup') AS author_requested
       FROM users""",
    "users",
)
def m6(spark, folder):
    asked = _user_commands(spark, folder, "signup")
    return commands.request_author(fx.users(spark, folder), asked).select("id", "author_requested")


SETTINGS_SQL = """WITH old AS (SELECT 'user.' || user_id AS k, max(props) AS v FROM events WHERE event_type = 'view' GROUP BY user_id),
         cmd AS (SELECT 'user.' || user_id AS k, arg_max(props, event_id) AS v FROM events WHERE event_type = 'click' GROUP BY user_id)
       SELECT coalesce(old.k, cmd.k) AS setting_key, CASE WHEN cmd.k IS NOT NULL THEN cmd.v ELSE old.v END AS value
       FROM old FULL JOIN cmd ON cmd.k = old.k"""


def _user_settings(spark, folder):
    """Stored settings, and commands that set some of them."""
    events = fx.table(spark, folder, "events").withColumn(
        "setting_key", F.concat(F.lit("user."), F.col("user_id").cast("string"))
    )
    stored = events.filter("event_type = 'view'").groupBy("setting_key").agg(F.max("props").alias("value"))
    asked = events.filter("event_type = 'click'").select("setting_key", F.col("props").alias("value"), F.col("event_id").alias("seq"))
    return stored, asked


@query("m7_settings_upsert", SETTINGS_SQL)
def m7(spark, folder):
    return commands.upsert_settings(*_user_settings(spark, folder))


@query("m7_settings_table", SETTINGS_SQL)
def m7_table(spark, folder):
    """The same in a stored table, of which only the buckets of changed keys are rewritten."""
    stored, asked = _user_settings(spark, folder)
    table = KeyedTable(spark, shared_path(spark, "settings"), "setting_key", buckets=8)
    table.upsert(stored.withColumn("seq", F.lit(-1).cast("bigint")), "seq")
    table.upsert(asked, "seq")
    return table.read().select("setting_key", "value")


@query(
    "m8_register_outcomes",
    f"""WITH {SIGNUPS_SQL}
        SELECT seq, email, CASE WHEN NOT terms_accepted THEN 'terms_required'
          WHEN email IN (SELECT email FROM users) THEN 'email_taken'
          WHEN seq = min(seq) FILTER (terms_accepted) OVER (PARTITION BY email) THEN 'registered' ELSE 'email_taken' END AS outcome
        FROM signups""",
    "users",
)
def m8_outcomes(spark, folder):
    return commands.register_users(fx.users(spark, folder), _signups(spark, folder), NOW).outcomes


@query(
    "m8_register_users",
    f"""WITH {SIGNUPS_SQL},
        firsts AS (SELECT email, min(seq) AS seq FROM signups WHERE terms_accepted AND email NOT IN (SELECT email FROM users) GROUP BY email)
        SELECT id, email, role, status, strftime(registration_date, '%Y-%m-%d') AS day FROM users
        UNION ALL
        SELECT (SELECT max(id) FROM users) + row_number() OVER (ORDER BY seq), email, 'User', 'Active', '2024-07-01' FROM firsts""",
    "users",
)
def m8(spark, folder):
    table = commands.register_users(fx.users(spark, folder), _signups(spark, folder), NOW).table
    return table.select("id", "email", "role", "status", F.date_format("registration_date", "yyyy-MM-dd").alias("day"))


SUBMITTED_SQL = f"""{DECIDED_SQL},
   sub AS (SELECT d.id AS seq, 'BB-' || CAST(id // 100 * 3 + 1 AS VARCHAR) AS target, d.user_id, d.parent_id, d.content, d.decision, d.label
           FROM decided d),
   done AS (SELECT s.*, CASE WHEN NOT EXISTS (SELECT 1 FROM users u WHERE u.id = s.user_id) THEN 'no_user'
       WHEN s.parent_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM comments c WHERE c.id = s.parent_id) THEN 'no_parent'
       WHEN s.parent_id IS NULL AND NOT EXISTS (SELECT 1 FROM articles a WHERE a.article_id = s.target) THEN 'no_article'
       WHEN decision = 'approve' THEN 'saved' WHEN decision = 'reject' THEN 'rejected'
       WHEN s.parent_id IS NOT NULL THEN 'saved' ELSE 'ignored' END AS outcome FROM sub s)"""


def _submitted(spark, folder):
    comments = fx.comments(spark, folder)
    new = comments.select(
        F.col("id").alias("seq"),
        F.concat(F.lit("BB-"), (F.floor(F.col("id") / 100) * 3 + 1).cast("string")).alias("article_id"),
        "user_id", "parent_id", "content",
    )
    return commands.add_comments(
        comments, new, fx.articles(spark, folder), fx.users(spark, folder), fx.scores(spark, folder), NOW, KEYWORDS
    )


@query(
    "m9_comment_outcomes",
    f"WITH {SUBMITTED_SQL} SELECT seq, outcome, decision FROM done",
    "articles comments users scores",
)
def m9_outcomes(spark, folder):
    return _submitted(spark, folder).outcomes.select("seq", "outcome", "decision")


@query(
    "m9_add_comments",
    f"""WITH {SUBMITTED_SQL} SELECT id, article_id, user_id, parent_id, status,
          strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM comments
        UNION ALL SELECT (SELECT max(id) FROM comments) + row_number() OVER (ORDER BY seq), target, user_id, parent_id, 'active', '{NOW}'
        FROM done WHERE outcome = 'saved'""",
    "articles comments users scores",
)
def m9(spark, folder):
    table = _submitted(spark, folder).table
    return table.select("id", "article_id", "user_id", "parent_id", "status", dates.stored_text(F.col("created_at")).alias("created_at"))


@query(
    "m10_like_comments",
    """SELECT c.id, CASE WHEN n IS NULL THEN c.likes ELSE coalesce(c.likes, 0) + n END AS likes
       FROM comments c LEFT JOIN (SELECT user_id * 100 AS id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1) e
       ON e.id = c.id""",
    "comments",
)
def m10(spark, folder):
    clicks = fx.table(spark, folder, "events").filter("event_type = 'click'")
    likes = clicks.select((F.col("user_id") * 100).alias("comment_id"))
    return commands.like_comments(fx.comments(spark, folder), likes).select("id", "likes")


@query(
    "m11_upload_articles",
    """SELECT article_id, title, status FROM articles
       UNION ALL
       SELECT 'BB-' || ((SELECT max(CAST(substring(article_id, 4) AS BIGINT)) FROM articles)
              + row_number() OVER (ORDER BY conv_id, turn)), substring(text, 1, 80), 'Pending' FROM conversations""",
    "articles",
)
def m11(spark, folder):
    articles = fx.articles(spark, folder)
    talk = fx.table(spark, folder, "conversations")
    given = {"title": F.substring("text", 1, 80), "content": F.col("text"), "status": F.lit("Pending")}
    uploads = talk.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("seq"),
        *[given.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in articles.dtypes],
    )
    return commands.upload_articles(articles, uploads).select("article_id", "title", "status")


# Streams


def _comment_days(spark, folder):
    path = shared_path(spark, "comment-days")
    rows = fx.comments(spark, folder).select("id", "article_id", "user_id", "parent_id", "content", "created_at")
    tables.write_comment_days(rows.withColumn("day", F.to_date("created_at")), path)
    return path


@query(
    "r1_moderation_stream",
    f"WITH {DECIDED_SQL} SELECT id, CAST(label AS INT) AS label, decision, reason FROM decided",
    "comments scores",
)
def r1(spark, folder):
    incoming = streams.read_comment_stream(spark, _comment_days(spark, folder))
    sink = shared_path(spark, "decisions")
    streams.moderate_stream(
        incoming, fx.scores(spark, folder), sink, shared_path(spark, "offsets"), KEYWORDS
    ).awaitTermination()
    return streams.read_decisions(spark, sink).select("id", "label", "decision", "reason")


R2_SQL = """SELECT DISTINCT substring(title, 1, 500) AS title FROM articles WHERE status = 'Pending'
       AND substring(title, 1, 500) NOT IN (SELECT substring(title, 1, 500) FROM articles WHERE status <> 'Pending')"""


def _title_stream(spark, folder):
    """Pending articles in four files, one micro-batch each, with dates mixed over the files; and the others."""
    path = shared_path(spark, "incoming-articles")
    articles = fx.articles(spark, folder).select("article_id", "title", "date_posted", "status")
    pending = articles.filter("status = 'Pending'").drop("status")
    pending.repartition(4, "article_id").write.parquet(path)
    incoming = spark.readStream.schema(pending.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return incoming, articles.filter("status <> 'Pending'")


@query("r2_title_stream", R2_SQL, "articles")
def r2(spark, folder):
    incoming, stored = _title_stream(spark, folder)
    out = shared_path(spark, "new-titles")
    streams.keep_new_titles(incoming, stored, out, shared_path(spark, "offsets"), ["article_id"]).awaitTermination()
    return spark.read.parquet(out).select("title")


@query("r2_title_stream_within", R2_SQL, "articles")
def r2_within(spark, folder):
    """The bounded form, with a horizon beyond all dates of the table."""
    incoming, stored = _title_stream(spark, folder)
    out = shared_path(spark, "new-titles")
    dated = incoming.withColumn("date_posted", F.coalesce("date_posted", F.lit(NOW).cast("timestamp")))
    streams.keep_new_titles_within(dated, stored, out, shared_path(spark, "offsets"), "date_posted", "36500 days").awaitTermination()
    return spark.read.parquet(out).select("title")
