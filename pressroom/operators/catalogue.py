"""Catalogue queries: filters, search, newest-first lists, paging, distinct values and reports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from pressroom.functions.display import category_name, first_image
from pressroom.operators.ranking import with_rank

NEWEST = ("date_posted", "article_id")
ARTICLES_PER_PAGE = 10
SEARCH_RESULTS_PER_PAGE = 3


def newest_first(date: str = "date_posted", key: str = "article_id") -> list[Column]:
    """NULL dates come first, as in a descending sort of the source database; ties by key."""
    return [F.col(date).desc_nulls_first(), F.col(key)]


def where_equal(df: DataFrame, **wanted: str | None) -> DataFrame:
    """Equality filters; a blank value means no filter."""
    for column, value in wanted.items():
        if value:
            df = df.filter(F.col(column) == value)
    return df


def contains_text(col: Column, text: str) -> Column:
    """Case-insensitive substring; ``%`` and ``_`` in the text stay wildcards.

    A backslash takes their meaning from ``%``, ``_`` and itself; before anything else it says nothing.
    """
    kept = re.sub(r"\\(.?)", lambda m: m[0] if m[1] in ("%", "_", "\\") else m[1], text, flags=re.S)
    return F.lower(col).like(f"%{kept}%".lower())


def published(articles: DataFrame) -> DataFrame:
    return articles.filter(F.col("status") == "published")


def pending(articles: DataFrame) -> DataFrame:
    """The review queue, newest first."""
    return articles.filter(F.col("status") == "Pending").orderBy(*newest_first())


def search_published(articles: DataFrame, query: str = "") -> DataFrame:
    found = published(articles)
    query = query.strip()
    return found.filter(contains_text(F.col("title"), query)) if query else found


def manage_articles(
    articles: DataFrame, category: str = "", status: str = "", query_text: str = ""
) -> DataFrame:
    found = where_equal(articles, type=category, status=status)
    return found.filter(contains_text(F.col("title"), query_text)) if query_text else found


# The status filter of the user list accepts these words, in any case.
USER_STATUS_FILTER = {"active": "Active", "inactive": "Inactive"}


def manage_users(users: DataFrame, role: str = "", status: str = "", query: str = "") -> DataFrame:
    """User list; unknown status words are ignored; the text may match first name or e-mail."""
    found = where_equal(users, role=role, status=USER_STATUS_FILTER.get(status.lower()))
    if query:
        found = found.filter(
            contains_text(F.col("first_name"), query) | contains_text(F.col("email"), query)
        )
    return found.orderBy("id")


# The public columns of a user row.
PUBLIC_USER_COLUMNS = (
    "id", "first_name", "last_name", "email", "phone", "newsletter", "terms_accepted",
    "role", "status", "registration_date", "avatar_url", "author_requested",
)


def public_users(users: DataFrame) -> DataFrame:
    """Public projection; stored columns outside the list, such as the password, never leave."""
    return users.select(*[column for column in PUBLIC_USER_COLUMNS if column in users.columns])


def newest(articles: DataFrame, n: int) -> DataFrame:
    return articles.orderBy(*newest_first()).limit(n)


def home_lists(articles: DataFrame) -> DataFrame:
    """Featured (1), popular (5) and latest (8) lists from one top-8, told apart by flags."""
    top = newest(published(articles), 8)
    return top.select(
        "*",
        F.row_number().over(_tiny_window()).cast("bigint").alias("place"),
    ).select("*", (F.col("place") <= 1).alias("featured"), (F.col("place") <= 5).alias("popular"))


def _tiny_window():
    """Window over a frame already limited to a handful of rows."""
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0)).orderBy(*newest_first())


def category_listing(articles: DataFrame, category: str) -> DataFrame:
    return where_equal(published(articles), type=category).orderBy(*newest_first())


# An offset page is a top-k of offset + size rows; a page past this offset is cut out of a
# distributed numbering of dates and keys instead.
DEEP_OFFSET = 10_000


def page(
    df: DataFrame, number: int, size: int = ARTICLES_PER_PAGE, date: str = "date_posted", key: str = "article_id"
) -> DataFrame:
    """One page by number."""
    offset = (max(number, 1) - 1) * size
    if offset <= DEEP_OFFSET:
        return df.orderBy(*newest_first(date, key)).offset(offset).limit(size)
    ranked = with_rank(df.select(date, key), newest_first(date, key), "_position")
    shown = ranked.filter((F.col("_position") > offset) & (F.col("_position") <= offset + size)).select(key)
    # Only dates and keys are numbered; the page's rows, ``size`` of them, are then looked up.
    return df.join(F.broadcast(shown), key, "left_semi").orderBy(*newest_first(date, key))


def page_after(
    df: DataFrame, last_date, last_key, size: int = ARTICLES_PER_PAGE, date: str = "date_posted", key: str = "article_id"
) -> DataFrame:
    """The page after a known row: a filter and a top-k, whatever the depth.

    ``last_date`` None stands for a row without a date; those come first.
    """
    if last_date is None:
        later = F.col(date).isNotNull() | (F.col(key) > F.lit(last_key))
    else:
        seen = F.lit(last_date).cast("timestamp")
        later = (F.col(date) < seen) | ((F.col(date) == seen) & (F.col(key) > F.lit(last_key)))
    return df.filter(later).orderBy(*newest_first(date, key)).limit(size)


def with_pages(
    df: DataFrame, size: int = ARTICLES_PER_PAGE, date: str = "date_posted", key: str = "article_id"
) -> DataFrame:
    """Number every row's page in one distributed pass."""
    ranked = with_rank(df, newest_first(date, key), "position")
    return ranked.withColumn("page_no", F.ceil(F.col("position") / size).cast("bigint"))


def page_summary(df: DataFrame, size: int = ARTICLES_PER_PAGE) -> DataFrame:
    """One row per page with its neighbours, from one count; no row is ranked for it."""
    total = df.count()
    pages = -(-total // size)
    number = F.col("page_no")
    return df.sparkSession.range(1, pages + 1).select(F.col("id").alias("page_no")).select(
        "page_no",
        F.lit(total).cast("bigint").alias("total"),
        F.lit(pages).cast("bigint").alias("total_pages"),
        F.least(F.lit(size), F.lit(total) - (number - 1) * size).cast("bigint").alias("rows_on_page"),
        (number > 1).alias("has_prev"),
        (number * size < total).alias("has_next"),
    )


def list_row(articles: DataFrame) -> DataFrame:
    """What list pages show: the first image instead of the list of images."""
    return articles.withColumn("image_urls", first_image(F.col("image_urls")))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def categories(articles: DataFrame) -> DataFrame:
    """Slug and display name per distinct stored type; slugs equal up to case stay separate."""
    types = distinct_values(articles, "type").filter(F.col("type").isNotNull())
    return types.select(F.lower("type").alias("slug"), category_name(F.col("type")).alias("name"))


def counted(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


def monthly_counts(df: DataFrame, date: str) -> DataFrame:
    """Rows per calendar month, ``yyyy-MM`` label; undated rows are left out."""
    dated = df.filter(F.col(date).isNotNull())
    month = F.date_format(F.col(date), "yyyy-MM")
    return dated.groupBy(month.alias("month")).agg(F.count(F.lit(1)).alias("count")).orderBy("month")


def monthly_totals(articles: DataFrame, users: DataFrame) -> DataFrame:
    """Grand totals over both monthly reports."""
    both = monthly_counts(articles, "date_posted").select(F.lit("articles").alias("report"), "count")
    both = both.unionByName(
        monthly_counts(users, "registration_date").select(F.lit("users").alias("report"), "count")
    )
    return both.groupBy("report").agg(
        F.sum("count").alias("total"), F.count(F.lit(1)).alias("months")
    )


def monthly_report(articles: DataFrame, users: DataFrame) -> DataFrame:
    """Both monthly reports with their grand totals, in one pass: report, month, count, is_total.

    The total of a report is the row without a month. Undated rows are left out.
    """
    rows = [
        df.filter(F.col(date).isNotNull()).select(F.lit(name).alias("report"), F.date_format(date, "yyyy-MM").alias("month"))
        for name, df, date in (("articles", articles, "date_posted"), ("users", users, "registration_date"))
    ]
    grouped = rows[0].unionByName(rows[1]).rollup("report", "month").agg(
        F.count(F.lit(1)).alias("count"), F.grouping_id().alias("_level")
    )
    # Levels: 0 a month, 1 a report, 3 all reports together, which means nothing.
    return grouped.filter("_level < 3").select("report", "month", "count", (F.col("_level") == 1).alias("is_total"))


def latest_contents(articles: DataFrame, limit: int | None = None) -> DataFrame:
    """Contents of the newest ``limit`` articles, or of all of them."""
    return (newest(articles, limit) if limit else articles).select("article_id", "content")


def all_settings(settings: DataFrame) -> DataFrame:
    """Every setting as a row."""
    return settings.select("setting_key", "value")


def settings_row(settings: DataFrame, keys: list[str]) -> DataFrame:
    """One map of the asked keys; its size is bounded by ``keys``, not by the table."""
    wanted = settings.filter(F.col("setting_key").isin(keys))
    return wanted.agg(
        F.map_from_entries(F.collect_list(F.struct("setting_key", "value"))).alias("settings")
    )
