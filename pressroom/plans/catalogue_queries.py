"""Queries over scans, filters, joins, reports and paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressroom import schemas
from pressroom.functions import dates, display, text
from pressroom.operators import catalogue, comments as comment_ops, commands, dedupe, topics
from pressroom.plans.registry import query
from pressroom.session import shared_path
from pressroom.sources import fixtures as fx, tables
from pressroom.sources.keyed_table import KeyedTable

def _brief(articles):
    return articles.select(
        "article_id", "title", "status", "type", dates.stored_text(F.col("date_posted")).alias("date_posted")
    )


BRIEF = "article_id, title, status, type, strftime(date_posted, '%Y-%m-%d %H:%M:%S') AS date_posted"


# Scans, sources and sinks


@query(
    "s1_article_scan",
    f"SELECT {BRIEF}, CAST(length(content) AS BIGINT) AS chars FROM articles",
    "articles",
)
def s1(spark, folder):
    rows = fx.articles(spark, folder)
    return rows.select(
        "article_id",
        "title",
        "status",
        "type",
        dates.stored_text(F.col("date_posted")).alias("date_posted"),
        F.length("content").cast("bigint").alias("chars"),
    )


@query(
    "s2_latest_contents",
    "SELECT article_id, content FROM articles ORDER BY date_posted DESC NULLS FIRST, article_id LIMIT 1000",
    "articles",
)
def s2(spark, folder):
    return catalogue.latest_contents(fx.articles(spark, folder), 1000)


@query(
    "s3_comment_scan",
    """SELECT c.id, c.article_id, a.title AS article_title, c.status
       FROM comments c LEFT JOIN articles a ON a.article_id = c.article_id""",
    "articles comments",
)
def s3(spark, folder):
    titles = fx.articles(spark, folder).select("article_id", F.col("title").alias("article_title"))
    scan = fx.comments(spark, folder).select("id", "article_id", "status")
    return scan.join(titles, "article_id", "left").select("id", "article_id", "article_title", "status")


@query(
    "s4_daily_comment_files",
    """SELECT content, 'user_comment' AS source, article_id,
              strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, strftime(created_at, '%Y-%m-%d') AS day
       FROM comments""",
    "comments",
)
def s4(spark, folder):
    path = shared_path(spark, "comment-days")
    rows = fx.comments(spark, folder).select(
        "content",
        F.lit("user_comment").alias("source"),
        "article_id",
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        F.to_date("created_at").alias("day"),
    )
    tables.write_comment_days(rows, path)
    return tables.read_comment_days(spark, path).withColumn("day", F.col("day").cast("string"))


EXPORT_SQL = """SELECT c.id, c.content,
    trim(lower(regexp_replace(regexp_replace(c.content, '<[^\\n]*?>', '', 'g'), '[^@WORD@SPACE]', '', 'g')), ' ' || chr(9) || chr(10) || chr(13)) AS cleaned_content,
    c.user_id, c.article_id, a.title AS article_title, a.type AS article_type,
    c.parent_id IS NOT NULL AS is_reply, c.parent_id,
    strftime(c.created_at, '%Y-%m-%d %H:%M:%S') AS created_at,
    CAST(epoch(c.created_at) AS BIGINT) AS timestamp
FROM comments c LEFT JOIN articles a ON a.article_id = c.article_id"""


def _export(spark, folder):
    rows = comment_ops.export_rows(fx.comments(spark, folder), fx.articles(spark, folder))
    return rows.withColumn("created_at", dates.stored_text(F.col("created_at")))


@query("s5_comment_export_csv", EXPORT_SQL, "articles comments")
def s5(spark, folder):
    path = shared_path(spark, "comment-export")
    rows = _export(spark, folder)
    tables.write_comment_export(rows, path)
    return tables.read_csv(spark, path, rows.schema)


def _pending(spark, folder):
    """Comments as the moderation table: hidden ones count as processed."""
    return fx.comments(spark, folder).select(
        F.col("id").cast("string").alias("comment_id"),
        "content",
        dates.stored_text(F.col("created_at")).alias("timestamp"),
        F.when(F.col("status") == "hidden", "processed").otherwise("pending").alias("status"),
        "parent_id",
    )


@query(
    "s6_pending_append",
    "SELECT CAST(id AS VARCHAR) AS comment_id, content, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS timestamp FROM comments",
    "comments",
)
def s6(spark, folder):
    path = shared_path(spark, "pending")
    rows = _pending(spark, folder)
    tables.add_pending(rows.filter(F.col("parent_id").isNull()), path, "first")
    tables.add_pending(rows.filter(F.col("parent_id").isNotNull()), path, "first")
    return tables.read_pending(spark, path).select(*schemas.PENDING_CSV.names)


@query(
    "s7_keyed_upsert",
    """SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type,
              arg_max(props, event_id) AS props
       FROM events GROUP BY user_id""",
)
def s7(spark, folder):
    events = fx.table(spark, folder, "events").select("user_id", "event_id", "event_type", "props")
    seen = F.col("event_type") == "view"
    stored = KeyedTable(spark, shared_path(spark, "latest-events"), "user_id", buckets=16)
    for rows in (events.filter(seen), events.filter(~seen)):
        stored.upsert(rows, "event_id")
    return stored.read()


@query(
    "s8_processed_batches",
    """SELECT CAST(id AS VARCHAR) AS comment_id, content, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS timestamp
       FROM comments WHERE status <> 'hidden'""",
    "comments",
)
def s8(spark, folder):
    path = shared_path(spark, "pending")
    rows = _pending(spark, folder)
    tables.add_pending(rows.filter("status = 'processed'"), path, "20240201_000000")
    tables.add_pending(rows.filter("status = 'pending'"), path, "20240202_000000")
    return tables.read_pending(spark, path, done=["20240201_000000"]).select(*schemas.PENDING_CSV.names)


@query("s9_append_articles", f"SELECT {BRIEF} FROM articles", "articles")
def s9(spark, folder):
    path = shared_path(spark, "articles")
    rows = fx.articles(spark, folder)
    tables.append_articles(rows.filter("status = 'published'"), path)
    tables.append_articles(rows.filter("status <> 'published'"), path)
    return _brief(tables.read_articles(spark, path))


TRAINING_WORDS_SQL = """
    SELECT doc_id, lang, lower(trim(w, '!"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~')) AS term
    FROM (SELECT doc_id, lang, unnest(regexp_split_to_array(text, '[@SPACE]+')) AS w FROM documents)"""
STOPWORDS_SQL = "(" + ", ".join(f"'{word}'" for word in text.STOPWORDS) + ")"
IS_WORD_SQL = f"length(term) > 2 AND term NOT IN {STOPWORDS_SQL}"


MODEL_TABLES_SQL = f"""SELECT term, count(*) AS total,
               concat_ws(',', count(*) FILTER (lang = 'de'), count(*) FILTER (lang = 'en'),
                              count(*) FILTER (lang = 'es'), count(*) FILTER (lang = 'fr')) AS per_class
        FROM ({TRAINING_WORDS_SQL}) WHERE {IS_WORD_SQL} GROUP BY term"""


@query("s10_model_tables", MODEL_TABLES_SQL)
def s10(spark, folder):
    path = shared_path(spark, "topic-model")
    topics.save_model(topics.fit(fx.table(spark, folder, "documents"), "text", "lang"), path)
    words = topics.load_model(spark, path).words
    return words.select("term", "total", F.array_join(F.col("n").cast("array<string>"), ",").alias("per_class"))


@query("s10_merged_model_tables", MODEL_TABLES_SQL)
def s10_merged(spark, folder):
    """Counts of three batches, added one after the other."""
    path = shared_path(spark, "topic-counts")
    docs = fx.table(spark, folder, "documents")
    for part in range(3):
        topics.add_to_counts(docs.filter(F.col("doc_id") % 3 == part), "text", "lang", path, f"part-{part}")
    words = topics.merged_model(spark, path).words
    return words.select("term", "total", F.array_join(F.col("n").cast("array<string>"), ",").alias("per_class"))


def _settings(spark, folder):
    """One setting per event type: the latest properties."""
    events = fx.table(spark, folder, "events")
    return events.groupBy(F.col("event_type").alias("setting_key")).agg(
        F.max_by("props", "event_id").alias("value")
    )


@query(
    "s11_all_settings",
    "SELECT event_type AS setting_key, arg_max(props, event_id) AS value FROM events GROUP BY event_type",
)
def s11_all(spark, folder):
    return catalogue.all_settings(_settings(spark, folder))


@query(
    "s11_settings_map",
    """SELECT event_type AS setting_key, arg_max(props, event_id) AS value
       FROM events WHERE event_type IN ('signup', 'purchase', 'view') GROUP BY event_type""",
)
def s11(spark, folder):
    row = catalogue.settings_row(_settings(spark, folder), ["signup", "purchase", "view"])
    return row.select(F.explode("settings").alias("setting_key", "value"))


@query(
    "s12_pending_to_score",
    """SELECT CAST(id AS VARCHAR) AS comment_id, content, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS timestamp
       FROM comments WHERE status <> 'hidden'""",
    "comments",
)
def s12(spark, folder):
    return tables.pending_to_score(_pending(spark, folder))


# Filters and projections


@query("p1_equality_filters", f"SELECT {BRIEF} FROM articles WHERE type = 'the-gioi' AND status = 'Pending'", "articles")
def p1(spark, folder):
    return _brief(catalogue.where_equal(fx.articles(spark, folder), type="the-gioi", status="Pending", author=""))


USER_SQL = "id, first_name, email, role, status"
USER_COLUMNS = ("id", "first_name", "email", "role", "status")


@query("p2_user_status_filter", f"SELECT {USER_SQL} FROM users WHERE status = 'Inactive'", "users")
def p2(spark, folder):
    return catalogue.manage_users(fx.users(spark, folder), status="INACTIVE").select(*USER_COLUMNS)


@query(
    "p3_title_search",
    f"SELECT {BRIEF} FROM articles WHERE lower(title) LIKE lower('%É_u%') ",
    "articles",
)
def p3(spark, folder):
    return _brief(catalogue.manage_articles(fx.articles(spark, folder), query_text="É_u"))


@query(
    "p4_user_search",
    f"SELECT {USER_SQL} FROM users WHERE lower(first_name) LIKE '%12%' OR lower(email) LIKE '%12%'",
    "users",
)
def p4(spark, folder):
    return catalogue.manage_users(fx.users(spark, folder), query="12").select(*USER_COLUMNS)


@query(
    "p5_status_subsets",
    """SELECT 'published' AS subset, article_id AS id FROM articles WHERE status = 'published'
       UNION ALL SELECT 'pending', article_id FROM articles WHERE status = 'Pending'
       UNION ALL SELECT 'active', CAST(id AS VARCHAR) FROM comments WHERE status = 'active'""",
    "articles comments",
)
def p5(spark, folder):
    articles = fx.articles(spark, folder)
    live = comment_ops.active(fx.comments(spark, folder)).select(
        F.lit("active").alias("subset"), F.col("id").cast("string").alias("id")
    )
    shown = catalogue.published(articles).select(F.lit("published").alias("subset"), F.col("article_id").alias("id"))
    waiting = articles.filter("status = 'Pending'").select(F.lit("pending").alias("subset"), F.col("article_id").alias("id"))
    return shown.unionByName(waiting).unionByName(live)


@query("p6_top_level_comments", "SELECT id, article_id, user_id FROM comments WHERE parent_id IS NULL", "comments")
def p6(spark, folder):
    return comment_ops.roots(fx.comments(spark, folder)).select("id", "article_id", "user_id")


@query("p7_id_prefix", "SELECT article_id, author FROM articles WHERE article_id LIKE 'BB-%'", "articles")
def p7(spark, folder):
    rows = _stored(spark, folder).select("article_id", "author")
    return rows.filter(F.startswith("article_id", F.lit(dedupe.ID_PREFIX)))


def _stored(spark, folder):
    """The articles as ``append_articles`` stores them."""
    path = shared_path(spark, "articles")
    tables.append_articles(fx.articles(spark, folder), path)
    return tables.read_articles(spark, path)


@query("p8_point_lookup", f"SELECT {BRIEF} FROM articles WHERE article_id = 'BB-3' AND status = 'Pending'", "articles")
def p8(spark, folder):
    return _brief(catalogue.where_equal(_stored(spark, folder), article_id="BB-3", status="Pending"))


CATEGORY_CASES = " ".join(
    f"WHEN '{slug}' THEN '{name}'" for slug, name in display.CATEGORY_NAMES.items()
)


CATEGORY_SQL = f"""CASE lower(type) {CATEGORY_CASES}
    ELSE array_to_string(list_transform(regexp_extract_all(replace(lower(type), '-', ' '),
         '\\p{{L}}+|[^\\p{{L}}]+'), lambda x: upper(x[1]) || lower(x[2:])), '') END"""


@query(
    "p9_category_names",
    f"SELECT article_id, lower(type) AS slug, {CATEGORY_SQL} AS name FROM articles",
    "articles",
)
def p9(spark, folder):
    return fx.articles(spark, folder).select(
        "article_id", F.lower("type").alias("slug"), display.category_name(F.col("type")).alias("name")
    )


@query(
    "p10_first_image",
    """SELECT article_id,
              CASE WHEN coalesce(image_urls, '') = '' THEN '' ELSE trim(split_part(image_urls, ',', 1)) END AS image,
              CASE WHEN coalesce(image_urls, '') = '' THEN '/static/images/default-thumbnail.jpg'
                   ELSE trim(split_part(image_urls, ',', 1)) END AS image_or_default
       FROM articles""",
    "articles",
)
def p10(spark, folder):
    urls = F.col("image_urls")
    return fx.articles(spark, folder).select(
        "article_id",
        display.first_image(urls).alias("image"),
        display.first_image(urls, display.DEFAULT_THUMBNAIL).alias("image_or_default"),
    )


NAMED_SQL = """SELECT c.id, c.user_id,
      CASE WHEN u.id IS NULL THEN 'Người dùng' ELSE u.first_name || ' ' || u.last_name END AS user_name,
      CAST(coalesce(c.likes, 0) AS BIGINT) AS likes
   FROM comments c LEFT JOIN users u ON u.id = c.user_id"""


@query("p11_display_names", NAMED_SQL, "comments users")
def p11(spark, folder):
    named = comment_ops.with_author_names(fx.comments(spark, folder), fx.users(spark, folder))
    return named.select("id", "user_id", "user_name", "likes")


@query(
    "p12_display_dates",
    """SELECT article_id, strftime(date_posted, '%d/%m/%Y %H:%M') AS minute,
              strftime(date_posted, '%d/%m/%Y') AS day, strftime(date_posted, '%d %B, %Y') AS long
       FROM articles""",
    "articles",
)
def p12(spark, folder):
    return fx.articles(spark, folder).select(
        "article_id", *[dates.display_date(F.col("date_posted"), s).alias(s) for s in dates.DISPLAY_FORMATS]
    )


@query(
    "p13_truncation",
    """SELECT article_id, substring(title, 1, 500) AS title, substring(content || title, 1, 1000) AS description,
              substring(content, 1, 8000) AS content, substring(content, 1, 255) AS author
       FROM articles""",
    "articles",
)
def p13(spark, folder):
    sources = {"title": F.col("title"), "description": F.concat("content", "title"),
               "content": F.col("content"), "author": F.col("content")}
    return fx.articles(spark, folder).select(
        "article_id", *[display.truncated(name, col).alias(name) for name, col in sources.items()]
    )


@query(
    "p14_list_text",
    """SELECT article_id, coalesce(array_to_string(string_split(image_urls, ' , '), ','), '') AS image_urls
       FROM articles""",
    "articles",
)
def p14(spark, folder):
    urls = F.split("image_urls", " , ")
    return fx.articles(spark, folder).select("article_id", display.list_text(urls).alias("image_urls"))


@query(
    "p15_snippets",
    """SELECT id, substring(content, 1, 50) || '...' AS short,
              CASE WHEN length(content) > 100 THEN substring(content, 1, 100) || '...' ELSE content END AS long
       FROM comments""",
    "comments",
)
def p15(spark, folder):
    return fx.comments(spark, folder).select(
        "id", text.snippet(F.col("content")).alias("short"), text.snippet_if_longer(F.col("content")).alias("long")
    )


@query(
    "p16_public_users",
    f"""SELECT {USER_SQL}, last_name, strftime(registration_date, '%Y-%m-%d') AS registration_date, author_requested
        FROM users""",
    "users",
)
def p16(spark, folder):
    with_secret = fx.users(spark, folder).withColumn("password", F.lit("x"))
    return catalogue.public_users(with_secret).withColumn(
        "registration_date", F.date_format("registration_date", "yyyy-MM-dd")
    )


# Joins


@query("j1_comments_with_articles", EXPORT_SQL, "articles comments")
def j1(spark, folder):
    return _export(spark, folder)


@query("j2_comments_with_users", NAMED_SQL.replace("SELECT c.id,", "SELECT c.id, c.article_id, c.status,"), "comments users")
def j2(spark, folder):
    named = comment_ops.with_author_names(fx.comments(spark, folder), fx.users(spark, folder))
    return named.select("id", "article_id", "status", "user_id", "user_name", "likes")


@query(
    "j3_comment_threads",
    """SELECT r.id AS root_id, r.id, r.user_id, false AS is_reply, strftime(r.created_at, '%Y-%m-%d %H:%M:%S') AS created_at
       FROM comments r WHERE r.parent_id IS NULL AND r.status = 'active'
       UNION ALL
       SELECT r.id, c.id, c.user_id, true, strftime(c.created_at, '%Y-%m-%d %H:%M:%S')
       FROM comments c JOIN comments r ON r.id = c.parent_id
       WHERE c.status = 'active' AND r.status = 'active' AND r.parent_id IS NULL""",
    "comments",
)
def j3(spark, folder):
    rows = comment_ops.threads(fx.comments(spark, folder))
    return rows.select("root_id", "id", "user_id", "is_reply", dates.stored_text(F.col("created_at")).alias("created_at"))


@query(
    "j4_verdicts_with_pending",
    """SELECT v.comment_id, CAST(v.label AS INT) AS label, c.id IS NOT NULL AS known, c.article_id
       FROM verdicts v LEFT JOIN comments c ON c.id = v.comment_id""",
    "comments verdicts",
)
def j4(spark, folder):
    waiting = fx.comments(spark, folder).select(F.col("id").alias("comment_id"), "article_id", F.lit(True).alias("_k"))
    return fx.verdicts(spark, folder).join(waiting, "comment_id", "left").select(
        "comment_id", F.col("label").cast("int").alias("label"), F.col("_k").isNotNull().alias("known"), "article_id"
    )


@query(
    "j5_existence_checks",
    """SELECT c.id, EXISTS (SELECT 1 FROM articles a WHERE a.article_id = c.article_id) AS has_article,
              EXISTS (SELECT 1 FROM users u WHERE u.id = c.user_id) AS has_user
       FROM comments c""",
    "articles comments users",
)
def j5(spark, folder):
    rows = fx.comments(spark, folder).select("id", "article_id", "user_id")
    articles = fx.articles(spark, folder).select("article_id")
    users = fx.users(spark, folder).select(F.col("id").alias("user_id"))
    kept = rows.join(articles, "article_id", "left_semi").select("id", F.lit(True).alias("a"))
    lost = rows.join(articles, "article_id", "left_anti").select("id", F.lit(False).alias("a"))
    owned = rows.join(users, "user_id", "left_semi").select("id", F.lit(True).alias("u"))
    return kept.unionByName(lost).join(owned, "id", "left").select(
        "id", F.col("a").alias("has_article"), F.coalesce("u", F.lit(False)).alias("has_user")
    )


@query(
    "j6_unknown_titles",
    """SELECT article_id, title FROM articles WHERE status = 'Pending'
       AND title NOT IN (SELECT title FROM articles WHERE status <> 'Pending' AND title IS NOT NULL)""",
    "articles",
)
def j6(spark, folder):
    articles = fx.articles(spark, folder).select("article_id", "title", "status")
    stored = articles.filter("status <> 'Pending'").select("title").distinct()
    return articles.filter("status = 'Pending'").join(stored, "title", "left_anti").select("article_id", "title")


SIGNUPS_SQL = """signups AS (
  SELECT event_id AS seq, 'customer#' || lpad(CAST(user_id * 37 AS VARCHAR), 9, '0') || '@example.com' AS email,
         value >= 2 AS terms_accepted
  FROM events WHERE event_type = 'signup')"""


def _signups(spark, folder):
    events = fx.table(spark, folder, "events").filter("event_type = 'signup'")
    number = F.lpad((F.col("user_id") * 37).cast("string"), 9, "0")
    return events.select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("customer#"), number, F.lit("@example.com")).alias("email"),
        F.lit("Reader").alias("first_name"),
        F.col("user_id").cast("string").alias("last_name"),
        (F.col("value") >= 2).alias("terms_accepted"),
    )


@query(
    "j7_free_emails",
    f"""WITH {SIGNUPS_SQL}
        SELECT email, min(seq) AS seq FROM signups
        WHERE email NOT IN (SELECT email FROM users) GROUP BY email""",
    "users",
)
def j7(spark, folder):
    asked = _signups(spark, folder).groupBy("email").agg(F.min("seq").alias("seq"))
    return asked.join(fx.users(spark, folder).select("email"), "email", "left_anti")


# Aggregations and reports


@query(
    "a1_filtered_counts",
    """SELECT count(*) FILTER (status = 'published') AS published,
              count(*) FILTER (status = 'published' AND lower(title) LIKE '%en%') AS found,
              count(*) AS total FROM articles""",
    "articles",
)
def a1(spark, folder):
    shown = F.col("status") == "published"
    return fx.articles(spark, folder).agg(
        F.count_if(shown).alias("published"),
        F.count_if(shown & catalogue.contains_text(F.col("title"), "en")).alias("found"),
        F.count(F.lit(1)).alias("total"),
    )


@query(
    "a2_distinct_values",
    """SELECT 'type' AS field, type AS value FROM articles GROUP BY type
       UNION ALL SELECT 'role', role FROM users GROUP BY role""",
    "articles users",
)
def a2(spark, folder):
    types = catalogue.distinct_values(fx.articles(spark, folder), "type").select(F.lit("type").alias("field"), F.col("type").alias("value"))
    roles = catalogue.distinct_values(fx.users(spark, folder), "role").select(F.lit("role").alias("field"), F.col("role").alias("value"))
    return types.unionByName(roles)


@query(
    "a3_monthly_articles",
    "SELECT strftime(date_posted, '%Y-%m') AS month, count(*) AS count FROM articles WHERE date_posted IS NOT NULL GROUP BY 1",
    "articles",
)
def a3(spark, folder):
    return catalogue.monthly_counts(fx.articles(spark, folder), "date_posted")


@query(
    "a4_monthly_users",
    "SELECT strftime(registration_date, '%Y-%m') AS month, count(*) AS count FROM users WHERE registration_date IS NOT NULL GROUP BY 1",
    "users",
)
def a4(spark, folder):
    return catalogue.monthly_counts(fx.users(spark, folder), "registration_date")


@query(
    "a5_report_totals",
    """SELECT 'articles' AS report, count(date_posted) AS total,
              count(DISTINCT strftime(date_posted, '%Y-%m')) AS months FROM articles
       UNION ALL
       SELECT 'users', count(registration_date), count(DISTINCT strftime(registration_date, '%Y-%m')) FROM users""",
    "articles users",
)
def a5(spark, folder):
    return catalogue.monthly_totals(fx.articles(spark, folder), fx.users(spark, folder))


@query(
    "a5_monthly_report",
    """SELECT report, month, count(*) AS count, grouping(month) = 1 AS is_total
       FROM (SELECT 'articles' AS report, strftime(date_posted, '%Y-%m') AS month FROM articles WHERE date_posted IS NOT NULL
             UNION ALL SELECT 'users', strftime(registration_date, '%Y-%m') FROM users WHERE registration_date IS NOT NULL)
       GROUP BY ROLLUP (report, month) HAVING grouping(report) = 0""",
    "articles users",
)
def a5_report(spark, folder):
    return catalogue.monthly_report(fx.articles(spark, folder), fx.users(spark, folder))


@query(
    "a6_comment_counters",
    """SELECT article_id, count(*) FILTER (status = 'active') AS active_comment_count,
              count(*) AS total_comment_count FROM comments GROUP BY article_id""",
    "comments",
)
def a6(spark, folder):
    return comment_ops.counters(fx.comments(spark, folder))


@query(
    "a7_root_reply_counts",
    "SELECT count(*) FILTER (parent_id IS NULL) AS roots, count(parent_id) AS replies, count(*) AS total FROM comments",
    "comments",
)
def a7(spark, folder):
    return comment_ops.root_and_reply_counts(fx.comments(spark, folder))


@query(
    "a11_max_article_number",
    "SELECT max(CAST(substring(article_id, 4) AS BIGINT)) AS max_number FROM articles WHERE article_id LIKE 'BB-%'",
    "articles",
)
def a11(spark, folder):
    return dedupe.max_article_number(fx.articles(spark, folder))


# Sorting and paging


@query(
    "l1_home_lists",
    f"""SELECT {BRIEF}, place, place <= 1 AS featured, place <= 5 AS popular FROM (
          SELECT *, row_number() OVER (ORDER BY date_posted DESC NULLS FIRST, article_id) AS place
          FROM articles WHERE status = 'published') WHERE place <= 8""",
    "articles",
)
def l1(spark, folder):
    top = catalogue.home_lists(fx.articles(spark, folder))
    return top.select(
        "article_id", "title", "status", "type", dates.stored_text(F.col("date_posted")).alias("date_posted"),
        "place", "featured", "popular",
    )


@query(
    "l2_category_listing",
    f"SELECT {BRIEF} FROM articles WHERE status = 'published' AND type = 'kinh-doanh'",
    "articles",
)
def l2(spark, folder):
    return _brief(catalogue.category_listing(fx.articles(spark, folder), "kinh-doanh"))


@query(
    "l3_article_page",
    f"SELECT {BRIEF} FROM articles ORDER BY articles.date_posted DESC NULLS FIRST, article_id LIMIT 10 OFFSET 20",
    "articles",
)
def l3(spark, folder):
    return _brief(catalogue.page(fx.articles(spark, folder), 3))


@query(
    "l3_search_page",
    f"""SELECT {BRIEF} FROM articles WHERE status = 'published' AND lower(title) LIKE '%en%'
        ORDER BY articles.date_posted DESC NULLS FIRST, article_id LIMIT 3 OFFSET 3""",
    "articles",
)
def l3_search(spark, folder):
    found = catalogue.search_published(fx.articles(spark, folder), "  En ")
    return _brief(catalogue.page(found, 2, catalogue.SEARCH_RESULTS_PER_PAGE))


@query(
    "l3_page_after",
    f"""SELECT {BRIEF} FROM articles WHERE articles.date_posted < TIMESTAMP '2024-01-08 00:00:00'
          OR (articles.date_posted = TIMESTAMP '2024-01-08 00:00:00' AND article_id > 'BB-169')
        ORDER BY articles.date_posted DESC NULLS FIRST, article_id LIMIT 10""",
    "articles",
)
def l3_after(spark, folder):
    return _brief(catalogue.page_after(fx.articles(spark, folder), "2024-01-08 00:00:00", "BB-169"))


@query(
    "l4_page_numbers",
    """SELECT article_id, position, CAST(ceil(position / 10.0) AS BIGINT) AS page_no FROM (
         SELECT article_id, row_number() OVER (ORDER BY date_posted DESC NULLS FIRST, article_id) AS position
         FROM articles WHERE status = 'published')""",
    "articles",
)
def l4(spark, folder):
    rows = catalogue.published(fx.articles(spark, folder)).select("article_id", "date_posted")
    return catalogue.with_pages(rows).select("article_id", "position", "page_no")


@query(
    "l4_page_summary",
    """WITH p AS (SELECT CAST(ceil(rn / 10.0) AS BIGINT) AS page_no, total FROM (
         SELECT row_number() OVER (ORDER BY article_id) AS rn, count(*) OVER () AS total
         FROM articles WHERE status = 'published'))
       SELECT page_no, total, CAST(ceil(total / 10.0) AS BIGINT) AS total_pages, count(*) AS rows_on_page,
              page_no > 1 AS has_prev, page_no * 10 < total AS has_next
       FROM p GROUP BY page_no, total""",
    "articles",
)
def l4_summary(spark, folder):
    return catalogue.page_summary(catalogue.published(fx.articles(spark, folder)))


@query("l5_users_by_id", f"SELECT {USER_SQL} FROM users WHERE role = 'author'", "users")
def l5(spark, folder):
    return catalogue.manage_users(fx.users(spark, folder), role="author").select(*USER_COLUMNS)


@query(
    "l6_thread_page",
    """WITH shown AS (SELECT id, created_at AS top FROM comments
          WHERE article_id = 'BB-2' AND parent_id IS NULL AND status = 'active'
          ORDER BY created_at DESC, id LIMIT 10),
       lines AS (SELECT c.*, s.top, s.id AS root FROM comments c JOIN shown s
          ON s.id = c.id OR (c.status = 'active' AND c.parent_id = s.id))
       SELECT l.id, l.parent_id, strftime(l.created_at, '%Y-%m-%d %H:%M:%S') AS created_at,
          CASE WHEN u.id IS NULL THEN 'Người dùng' ELSE u.first_name || ' ' || u.last_name END AS user_name,
          row_number() OVER (ORDER BY l.top DESC, l.root, l.parent_id IS NOT NULL, l.created_at, l.id) AS position
       FROM lines l LEFT JOIN users u ON u.id = l.user_id""",
    "comments users",
)
def l6(spark, folder):
    rows = comment_ops.thread_page(fx.comments(spark, folder), "BB-2", users=fx.users(spark, folder))
    return rows.select("id", "parent_id", dates.stored_text(F.col("created_at")).alias("created_at"), "user_name", "position")


@query("l7_pending_queue", f"SELECT {BRIEF} FROM articles WHERE status = 'Pending'", "articles")
def l7(spark, folder):
    return _brief(catalogue.pending(fx.articles(spark, folder)))


@query(
    "search_published",
    f"SELECT {BRIEF} FROM articles WHERE status = 'published' AND lower(title) LIKE '%en%'",
    "articles",
)
def search(spark, folder):
    return _brief(catalogue.search_published(fx.articles(spark, folder), "en"))


@query(
    "category_list",
    f"SELECT lower(type) AS slug, {CATEGORY_SQL} AS name FROM (SELECT DISTINCT type FROM articles)",
    "articles",
)
def category_list(spark, folder):
    return catalogue.categories(fx.articles(spark, folder))
