"""Queries over page extraction, deduplication and the intake job."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from pressroom.functions import dates
from pressroom.operators import dedupe, pages as page_ops, topics
from pressroom.operators.ranking import first_per_key, with_rank
from pressroom.plans.ingest import ingest, ingest_into, prepare_rows
from pressroom.plans.registry import query
from pressroom.plans.text_queries import ALL_SQL, model_sql, scored_sql, squash_sql, strip_sql
from pressroom.session import settle, shared_path
from pressroom.sources import fixtures as fx
from pressroom.sources.catalogue_store import CatalogueStore

DEFAULT_TS = "2024-06-01 00:00:00"


def _default_ts():
    return F.lit(DEFAULT_TS).cast("timestamp")


def _pages(spark, folder):
    return fx.table(spark, folder, "pages")


def _articles_of(spark, folder, rules=None):
    return page_ops.extract_articles(_pages(spark, folder), _default_ts(), rules or fx.page_sites())


# The ``pages`` table in SQL: routing, and article texts read with string functions.


def unescape_sql(c):
    for entity, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        c = f"replace({c}, '{entity}', '{char}')"
    return c


SITE_SQL = """CASE WHEN contains(url, '//blog.') THEN 'blog' WHEN contains(url, '//www.') THEN 'www'
    WHEN contains(url, 'example.com') THEN 'com' WHEN contains(url, 'example.net') THEN 'net' END"""

PAGES_SQL = f"""routed AS (SELECT *, {SITE_SQL} AS site FROM pages WHERE {SITE_SQL} IS NOT NULL),
  raw AS (SELECT page_id, url, site,
      regexp_extract(html, '<h1>(.*?)</h1>', 1, 's') AS h1,
      regexp_extract(html, '<div class="ad">(.*?)</div>', 1, 's') AS ad,
      regexp_extract(html, '<footer>(.*?)</footer>', 1, 's') AS foot,
      string_split(regexp_extract(html, '<article>(.*)</article>', 1, 's'), '<p>')[2:] AS segs FROM routed),
  blocks AS (SELECT page_id, i, CASE WHEN contains(segs[i], '</p>') THEN split_part(segs[i], '</p>', 1)
        ELSE array_to_string(segs[i:], '') END AS block
      FROM (SELECT page_id, segs, unnest(generate_series(1, len(segs))) AS i FROM raw)),
  texts AS (SELECT page_id, i, array_to_string(list_transform(regexp_split_to_array(block, '<[^>]*>'),
        lambda x: {strip_sql(unescape_sql('x'))}), '') AS txt FROM blocks),
  joined AS (SELECT page_id, string_agg(txt || chr(10), '' ORDER BY i) AS plain,
        string_agg('<p class="article-paragraph">' || txt || '</p>' || chr(10), '' ORDER BY i) AS body
      FROM texts GROUP BY page_id),
  pg AS (SELECT r.page_id, r.url, r.site, {strip_sql(unescape_sql('r.h1'))} AS title,
        {strip_sql(unescape_sql('r.ad'))} AS description,
        substring({squash_sql(unescape_sql('r.foot'))}, 1, 255) AS author,
        coalesce(j.plain, '') AS plain_content,
        '<div class="article-contents">' || chr(10) || coalesce(j.body, '') || '</div>' AS content
      FROM raw r LEFT JOIN joined j ON j.page_id = r.page_id
      WHERE NOT (r.site = 'net' AND {strip_sql("coalesce(j.plain, '')")} = ''))"""


@query("x1_site_router", f"SELECT page_id, url, {SITE_SQL} AS site FROM pages WHERE {SITE_SQL} IS NOT NULL")
def x1(spark, folder):
    return page_ops.routed(_pages(spark, folder), fx.page_sites()).select("page_id", "url", "site")


@query(
    "x2_article_extraction",
    f"""WITH {PAGES_SQL} SELECT page_id, site, title, description, author, plain_content,
        '{DEFAULT_TS}' AS date_posted, 'published' AS status, url AS source_url FROM pg""",
)
def x2(spark, folder):
    return _articles_of(spark, folder).select(
        "page_id", "site", "title", "description", "author", "plain_content",
        dates.stored_text(F.col("date_posted")).alias("date_posted"), "status", "source_url",
    )


@query("x9_plain_text", f"WITH {PAGES_SQL} SELECT page_id, plain_content FROM pg")
def x9(spark, folder):
    return _articles_of(spark, folder).select("page_id", "plain_content")


@query("x10_html_rendering", f"WITH {PAGES_SQL} SELECT page_id, content FROM pg")
def x10(spark, folder):
    return _articles_of(spark, folder).select("page_id", "content")


@query(
    "x11_boilerplate_removal",
    f"""WITH {PAGES_SQL},
        cut AS (SELECT page_id, min(i) AS at FROM blocks WHERE starts_with(block, '<b>') GROUP BY page_id)
        SELECT r.page_id, coalesce(string_agg(CASE WHEN t.i = c.at THEN '' ELSE t.txt END || chr(10), '' ORDER BY t.i), '')
               AS plain_content
        FROM raw r LEFT JOIN cut c ON c.page_id = r.page_id
        LEFT JOIN texts t ON t.page_id = r.page_id AND t.i <= coalesce(c.at, t.i)
        GROUP BY r.page_id""",
)
def x11(spark, folder):
    rules = {name: replace(rule, drop=("b",), needs_text=False) for name, rule in fx.page_sites().items()}
    return _articles_of(spark, folder, rules).select("page_id", "plain_content")


@query(
    "x16_pages_without_body",
    f"WITH {PAGES_SQL} SELECT page_id, site, title FROM pg WHERE site <> 'www'",
)
def x16(spark, folder):
    rules = fx.page_sites()
    rules["www"] = replace(rules["www"], body="div.missing")
    return _articles_of(spark, folder, rules).select("page_id", "site", "title")


# List pages: the navigation of each page.


LINKS_SQL = f"""found AS (SELECT page_id, site, i AS position, hrefs[i] AS href, {strip_sql(unescape_sql('names[i]'))} AS name
    FROM (SELECT page_id, site, hrefs, names, unnest(generate_series(1, len(hrefs))) AS i FROM (
      SELECT page_id, {SITE_SQL} AS site, regexp_extract_all(html, '<li><a href="([^"]*)">', 1) AS hrefs,
             regexp_extract_all(html, '<li><a href="[^"]*">(.*?)</a>', 1) AS names
      FROM pages) WHERE site IS NOT NULL)),
  items AS (SELECT page_id, site, CAST(position AS INT) AS position, {unescape_sql('href')} AS href, name,
    CASE WHEN starts_with(href, 'http') THEN {unescape_sql('href')} ELSE 'https://example.test' || {unescape_sql('href')} END AS url
    FROM found)"""


def _links(spark, folder):
    return page_ops.extract_links(_pages(spark, folder), fx.page_sites())


@query("x3_listing_links", f"WITH {LINKS_SQL} SELECT page_id, site, position, href, name FROM items")
def x3(spark, folder):
    return _links(spark, folder).select(
        "page_id", "site", "position", "href", page_ops.link_title(fx.page_sites()).alias("name")
    )


@query("x4_listing_filters", f"WITH {LINKS_SQL} SELECT page_id, site, position FROM items WHERE length(name) > 5 AND site <> 'com'")
def x4(spark, folder):
    # "com" asks for a thumbnail here, which no item has.
    rules = fx.page_sites()
    rules["com"] = replace(rules["com"], listing=replace(rules["com"].listing, needs=("thumbnail",)))
    kept = page_ops.extract_links(_pages(spark, folder), rules).filter(page_ops.accepted(rules))
    return kept.filter(F.length(page_ops.link_title(rules)) > 5).select("page_id", "site", "position")


LIMITED_SQL = """early AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY position) AS rn FROM items WHERE site = 'www'),
  kept_early AS (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY position) AS u FROM early WHERE rn <= 4),
  late AS (SELECT *, CASE WHEN site = 'blog' THEN row_number() OVER (PARTITION BY page_id, url ORDER BY position) ELSE 1 END AS u
           FROM items WHERE site <> 'www'),
  kept_late AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY position) AS rn2 FROM late WHERE u = 1)"""


@query(
    "x5_site_limit",
    f"""WITH {LINKS_SQL}, {LIMITED_SQL}
        SELECT page_id, site, position, name AS title, url FROM kept_early WHERE u = 1
        UNION ALL SELECT page_id, site, position, name, url FROM kept_late WHERE rn2 <= 4""",
)
def x5(spark, folder):
    # Four links of each list page: the pages of the test table have six.
    return page_ops.listing(_pages(spark, folder), fx.page_sites(), limit=4).select("page_id", "site", "position", "title", "url")


@query(
    "x6_url_dedupe",
    f"""WITH {LINKS_SQL} SELECT site, url, page_id, position FROM (
          SELECT *, row_number() OVER (PARTITION BY site, url ORDER BY page_id, position) AS rn FROM items) WHERE rn = 1""",
)
def x6(spark, folder):
    links = _links(spark, folder).withColumn("url", page_ops.absolute_url(fx.page_sites()))
    return first_per_key(links, ["site", "url"], ["page_id", "position"]).select("site", "url", "page_id", "position")


@query("x7_absolute_urls", f"WITH {LINKS_SQL} SELECT page_id, position, href, url FROM items")
def x7(spark, folder):
    return _links(spark, folder).select(
        "page_id", "position", "href", page_ops.absolute_url(fx.page_sites()).alias("url")
    )


@query(
    "x8_union_of_sites",
    f"""WITH {LINKS_SQL} SELECT url, name AS title, CASE WHEN site = 'com' THEN 'Unknown' END AS date_posted,
        CASE WHEN site = 'net' THEN page_id END AS page_id FROM items""",
)
def x8(spark, folder):
    rules = fx.page_sites()
    links = _links(spark, folder).select(
        "site", "page_id", page_ops.absolute_url(rules).alias("url"), page_ops.link_title(rules).alias("title")
    )
    links = settle(links, "links")  # the pages are parsed once for all sites
    extra = {"com": [F.lit("Unknown").alias("date_posted")], "net": ["page_id"]}
    sites = [links.filter(F.col("site") == name).select("url", "title", *extra.get(name, [])) for name in rules]
    return page_ops.union_sites(sites)


# Article pages of the six known sites, rendered from the stored articles.


def _escaped(col):
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        col = F.replace(col, F.lit(char), F.lit(entity))
    return col


SITE_NAMES = list(page_ops.SITES)


def _known_pages(spark, folder):
    """One page per document. Title, description, author, date and body are missing now and then."""
    docs = fx.table(spark, folder, "documents").select("doc_id", "text")
    n = F.col("doc_id")
    site = F.element_at(F.array(*[F.lit(name) for name in SITE_NAMES]), (n % 6 + 1).cast("int"))
    title = _escaped(F.split_part("text", F.lit("\n"), F.lit(1)))
    words = _escaped(F.col("text"))
    number = n.cast("string")

    def tag(name, attrs, inner, missing):
        return F.when(n % missing == 0, "").otherwise(F.concat(F.lit(f"<{name}{attrs}>"), inner, F.lit(f"</{name}>")))

    strict = F.concat(F.lit("Thứ tư, "), (n % 28 + 1).cast("string"), F.lit("/3/2025, 9:05 (GMT+7)"))
    free = F.concat((n % 28 + 1).cast("string"), F.lit("/3/2025 09:05 GMT+7"))
    pic = F.concat(F.lit("https://img.test/"), number, F.lit(".jpg"))
    parts = {
        "nld": (tag("h1", "", title, 7), tag("h2", "", words, 5), "div class='detail-content afcbc-body'",
                F.concat(F.lit("<figure><img src='"), pic, F.lit("'><figcaption> cap </figcaption></figure>")),
                tag("p", " class='author-info'", F.concat(F.lit("  An \n"), number), 4), tag("span", " class='date'", free, 3)),
        "vnexpress": (tag("h1", " class='title-detail'", title, 7), tag("p", " class='description'", words, 5), "article class='fck_detail'",
                      F.concat(F.lit("<figure><img src='"), pic, F.lit("'></figure>"),
                               tag("p", " style='text-align:right;'", F.concat(F.lit("<strong> An "), number, F.lit("</strong> x")), 4)),
                      F.lit(""), tag("span", " class='date'", strict, 3)),
        "vietnamnet": (tag("h1", " class='content-detail-title'", title, 7), tag("h2", " class='content-detail-sapo'", words, 5),
                       "div class='maincontent main-content'",
                       F.concat(F.lit("<figure><picture><source data-srcset='"), pic, F.lit(" 2x'></picture><img alt='a'></figure><div class='ck-cms-insert-neww-group'><p>ad</p></div>")),
                       tag("div", " class='article-detail-author author-single'", F.concat(F.lit("<span class='name'>An "), number, F.lit("</span>")), 4),
                       tag("time", "", strict, 3)),
        "vietnamplus": (tag("h1", "", title, 7), tag("div", " class='article__sapo cms-desc'", words, 5), "div class='article__body'",
                        F.concat(F.lit("<figure><img class='cms-photo' src='"), pic, F.lit("'></figure><figure><img src='https://img.test/skip.jpg'></figure>")),
                        F.concat(F.lit("<div class='article__meta'>"),
                                 tag("span", " class='author cms-author'", F.concat(F.lit(" An "), number), 4),
                                 tag("time", " class='time'", free, 3), F.lit("</div>")), F.lit("")),
        "tuoitre": (tag("h1", "", title, 7), tag("h2", "", words, 5), "div class='detail-content afcbc-body'",
                    F.concat(F.lit("<figure><img src='"), pic, F.lit("'></figure><p><img src='https://img.test/inline.jpg'></p>")),
                    tag("div", " class='detail-author'", F.concat(F.lit("An "), number), 4), tag("div", " data-role='publishdate'", free, 3)),
        "dantri": (tag("h1", " class='title-page'", title, 7), tag("h2", " class='singular-sapo'", words, 5), "div class='singular-content'",
                   F.concat(F.lit("<figure class='image align-center'><img data-original=' "), pic, F.lit(" ' src='x.gif'></figure><div class='box-taitro'><p>ad</p></div>")),
                   tag("div", " class='author-name'", F.concat(F.lit("An "), number), 4), tag("time", " class='time'", strict, 3)),
    }
    cases = []
    for name, (head, lead, body, figure, author, date) in parts.items():
        opened, closed = F.lit(f"<{body}>"), F.lit(f"</{body.split()[0]}>")
        inner = F.concat(opened, F.lit("<p>"), F.replace(words, F.lit("\n"), F.lit("</p><p>")), F.lit("</p>"), figure, closed)
        html = F.concat(
            F.lit("<html><body>"), head, lead, F.when(n % 11 == 0, "").otherwise(inner), author, date,
            F.lit("<video src='https://vid.test/"), number, F.lit(".mp4'></video></body></html>"),
        )
        cases.append(F.when(site == name, html))
    return docs.select(
        n.alias("page_id"),
        F.concat(F.lit("https://"), F.element_at(F.create_map(*[F.lit(v) for name in SITE_NAMES for v in (name, page_ops.SITES[name].host)]), site),
                 F.lit("/"), number).alias("url"),
        F.coalesce(*cases).alias("html"),
    )


def _known_articles(spark, folder):
    return page_ops.extract_articles(_known_pages(spark, folder), _default_ts(), compat=True)


KNOWN_SQL = "CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(SITE_NAMES)) + " END"
KNOWN = f"known AS (SELECT *, {KNOWN_SQL} AS site FROM documents WHERE doc_id % 11 <> 0)"


@query(
    "x12_image_urls",
    f"""WITH {KNOWN} SELECT doc_id AS page_id, site, 'https://img.test/' || doc_id || '.jpg' ||
          CASE WHEN site = 'tuoitre' THEN ',https://img.test/inline.jpg' ELSE '' END AS image_urls FROM known""",
)
def x12(spark, folder):
    return _known_articles(spark, folder).select("page_id", "site", F.array_join("image_urls", ",").alias("image_urls"))


@query("x13_video_urls", f"WITH {KNOWN} SELECT doc_id AS page_id, 'https://vid.test/' || doc_id || '.mp4' AS video_urls FROM known")
def x13(spark, folder):
    return _known_articles(spark, folder).select("page_id", F.array_join("video_urls", ",").alias("video_urls"))


@query(
    "x14_field_defaults",
    f"""WITH {KNOWN} SELECT doc_id AS page_id, site,
          CASE WHEN doc_id % 7 = 0 THEN 'No title' ELSE {strip_sql("split_part(text, chr(10), 1)")} END AS title,
          CASE WHEN doc_id % 5 = 0 THEN 'No description' ELSE {strip_sql("text")} END AS description
        FROM known""",
)
def x14(spark, folder):
    return _known_articles(spark, folder).select("page_id", "site", "title", "description")


@query(
    "x15_author_line",
    f"WITH {KNOWN} SELECT doc_id AS page_id, site, CASE WHEN doc_id % 4 = 0 THEN 'Unknown author' ELSE 'An ' || doc_id END AS author FROM known",
)
def x15(spark, folder):
    return _known_articles(spark, folder).select("page_id", "site", "author")


@query(
    "x19_stored_timestamps",
    f"""WITH {KNOWN} SELECT doc_id AS page_id, site,
          CASE WHEN doc_id % 3 = 0 OR site IN ('vnexpress', 'vietnamnet', 'dantri') THEN '{DEFAULT_TS}'
               ELSE strftime(make_timestamp(2025, 3, CAST(doc_id % 28 + 1 AS BIGINT), 9, 5, 0), '%Y-%m-%d %H:%M:%S') END AS date_posted
        FROM known""",
)
def x19(spark, folder):
    """The strict sites show ``Thứ tư``, which the compatible rule cannot read: they get the default."""
    return _known_articles(spark, folder).select(
        "page_id", "site", dates.stored_text(F.col("date_posted")).alias("date_posted")
    )


@query(
    "x19_strict_sites",
    f"""WITH {KNOWN} SELECT doc_id AS page_id, site, CASE WHEN doc_id % 3 = 0 THEN '{DEFAULT_TS}'
               ELSE strftime(make_timestamp(2025, 3, CAST(doc_id % 28 + 1 AS BIGINT), 9, 5, 0), '%Y-%m-%d %H:%M:%S') END AS date_posted
        FROM known""",
)
def x19_strict(spark, folder):
    """The same pages with every weekday prefix read."""
    found = page_ops.extract_articles(_known_pages(spark, folder), _default_ts())
    return found.select("page_id", "site", dates.stored_text(F.col("date_posted")).alias("date_posted"))


@query(
    "x17_strict_dates",
    """SELECT event_id, CASE WHEN event_id % 5 = 4 THEN '2024-06-01 00:00:00' ELSE strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') END AS fixed,
              CASE WHEN event_id % 5 IN (1, 3, 4) THEN '2024-06-01 00:00:00'
                   ELSE strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') END AS compat
       FROM events""",
)
def x17(spark, folder):
    days = F.array(*[F.lit(d) for d in ("Thứ hai, ", "Thứ tư, ", "", "Chủ nhật, ", "hôm qua ")])
    day = F.element_at(days, (F.col("event_id") % 5 + 1).cast("int"))
    shown = F.concat(day, F.date_format("ts", "d/M/yyyy, HH:mm"), F.lit(" (GMT+7)"))
    return fx.table(spark, folder, "events").select(
        "event_id",
        dates.normalise_strict(shown, _default_ts()).alias("fixed"),
        dates.normalise_strict(shown, _default_ts(), compat=True).alias("compat"),
    )


@query(
    "x18_free_dates",
    """SELECT event_id, CASE event_id % 4 WHEN 3 THEN '2024-06-01 00:00:00'
         WHEN 2 THEN strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S')
         WHEN 1 THEN strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S')
         ELSE strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') END AS stored FROM events""",
)
def x18(spark, folder):
    kind = F.col("event_id") % 4
    shown = (
        F.when(kind == 0, F.date_format("ts", "dd/MM/yyyy HH:mm:ss"))
        .when(kind == 1, F.date_format("ts", "d-M-yyyy HH:mm"))
        .when(kind == 2, F.date_format("ts", "d/M/yyyy"))
        .otherwise("Unknown")
    )
    return fx.table(spark, folder, "events").select(
        "event_id", dates.normalise_free(F.concat(shown, F.lit(" GMT+7")), _default_ts()).alias("stored")
    )


# Deduplication and ids


def _new_and_stored(spark, folder):
    """Every tenth document is stored, the others are new."""
    docs = fx.table(spark, folder, "documents").select("doc_id", "text")
    is_stored = F.col("doc_id") % 10 == 0
    return docs.filter(~is_stored), docs.filter(is_stored)


SIMILAR_SQL = """stored AS (SELECT doc_id, text FROM documents WHERE doc_id % 10 = 0),
   fresh AS (SELECT doc_id, text FROM documents WHERE doc_id % 10 <> 0),
   st AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[@WORD]{2,}')) AS term FROM stored) GROUP BY ALL),
   nt AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[@WORD]{2,}')) AS term FROM fresh)
          WHERE term IN (SELECT term FROM st) GROUP BY ALL),
   sn AS (SELECT doc_id, sum(n * n) AS q FROM st GROUP BY doc_id), nn AS (SELECT doc_id, sum(n * n) AS q FROM nt GROUP BY doc_id),
   dots AS (SELECT nt.doc_id AS a, st.doc_id AS b, sum(nt.n * st.n) AS dot FROM nt JOIN st ON st.term = nt.term GROUP BY ALL),
   dup AS (SELECT DISTINCT a FROM dots JOIN nn ON nn.doc_id = a JOIN sn ON sn.doc_id = b WHERE 25 * dot * dot >= 16 * nn.q * sn.q)"""


@query(
    "d1_near_duplicates",
    f"WITH {SIMILAR_SQL} SELECT doc_id, doc_id IN (SELECT a FROM dup) AS near_duplicate FROM fresh",
)
def d1(spark, folder):
    new, stored = _new_and_stored(spark, folder)
    return dedupe.flag_near_duplicates(new, stored, "doc_id", "text")


ALL_STORED_SQL = SIMILAR_SQL.replace("doc_id % 10 = 0", "doc_id % 2 = 0").replace("doc_id % 10 <> 0", "doc_id % 2 <> 0")


@query(
    "d1_near_duplicates_all_stored",
    f"WITH {ALL_STORED_SQL} SELECT doc_id, doc_id IN (SELECT a FROM dup) AS near_duplicate FROM fresh",
)
def d1_all(spark, folder):
    """Half of the documents against all of the other half, in blocks."""
    docs = fx.table(spark, folder, "documents").select("doc_id", "text")
    is_stored = F.col("doc_id") % 2 == 0
    stored = dedupe.stored_window(docs.filter(is_stored), window=None)
    return dedupe.flag_near_duplicates(docs.filter(~is_stored), stored, "doc_id", "text", index_pairs=50_000)


@query(
    "j8_similarity_anti_join",
    f"WITH {SIMILAR_SQL} SELECT doc_id, text FROM fresh WHERE doc_id NOT IN (SELECT a FROM dup)",
)
def j8(spark, folder):
    new, stored = _new_and_stored(spark, folder)
    return dedupe.drop_near_duplicates(new, stored, "doc_id", "text")


@query(
    "d2_title_dedupe",
    """SELECT article_id, title FROM (
         SELECT article_id, title, row_number() OVER (PARTITION BY substring(title, 1, 500) ORDER BY article_id) AS rn
         FROM articles WHERE status = 'Pending') WHERE rn = 1
       AND substring(title, 1, 500) NOT IN (SELECT substring(title, 1, 500) FROM articles WHERE status <> 'Pending')""",
    "articles",
)
def d2(spark, folder):
    rows = fx.articles(spark, folder).select("article_id", "title", "status")
    new = rows.filter("status = 'Pending'").select("article_id", "title")
    return dedupe.drop_known_titles(new, rows.filter("status <> 'Pending'"), ["article_id"])


@query(
    "d3_new_article_ids",
    """SELECT 'BB-' || ((SELECT max(CAST(substring(article_id, 4) AS BIGINT)) FROM articles)
              + row_number() OVER (ORDER BY id)) AS article_id, id FROM comments""",
    "articles comments",
)
def d3(spark, folder):
    new = fx.comments(spark, folder).select("id")
    return dedupe.with_article_ids(new, fx.articles(spark, folder), ["id"]).select("article_id", "id")


@query(
    "d4_sequential_numbers",
    "SELECT event_id, row_number() OVER (ORDER BY user_id, ts, event_id) AS number FROM events",
)
def d4(spark, folder):
    events = fx.table(spark, folder, "events").select("event_id", "user_id", "ts")
    return with_rank(events, ["user_id", "ts", "event_id"], "number").select("event_id", "number")


@query(
    "d4_numbers_within_group",
    "SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS number FROM events",
)
def d4_within(spark, folder):
    events = fx.table(spark, folder, "events").select("event_id", "event_type", "ts")
    return with_rank(events, ["ts", "event_id"], "number", within=["event_type"]).select("event_id", "number")


@query(
    "d5_prepared_rows",
    """SELECT article_id, substring(title, 1, 500) AS title, substring(content, 1, 8000) AS content,
              coalesce(array_to_string(string_split(image_urls, ' , '), ','), '') AS image_urls
       FROM articles""",
    "articles",
)
def d5_rows(spark, folder):
    rows = fx.articles(spark, folder).select("article_id", "title", "content", F.split("image_urls", " , ").alias("image_urls"))
    return prepare_rows(rows)


INTAKE_SQL = f"""WITH catalogue AS (SELECT * FROM articles WHERE CAST(substring(article_id, 4) AS BIGINT) % 2 = 1), {PAGES_SQL}, {model_sql(ALL_SQL)}, {scored_sql('SELECT page_id AS id, plain_content AS text FROM pg')},
   stored AS (SELECT article_id, content AS text FROM catalogue ORDER BY date_posted DESC NULLS FIRST, article_id LIMIT 1000),
   st AS (SELECT article_id, term, count(*) AS n FROM (SELECT article_id, unnest(regexp_extract_all(lower(text), '[@WORD]{{2,}}')) AS term FROM stored) GROUP BY ALL),
   nt AS (SELECT page_id, term, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(lower(content), '[@WORD]{{2,}}')) AS term FROM pg)
          WHERE term IN (SELECT term FROM st) GROUP BY ALL),
   sn AS (SELECT article_id, sum(n * n) AS q FROM st GROUP BY article_id), nn AS (SELECT page_id, sum(n * n) AS q FROM nt GROUP BY page_id),
   dots AS (SELECT nt.page_id AS a, st.article_id AS b, sum(nt.n * st.n) AS dot FROM nt JOIN st ON st.term = nt.term GROUP BY ALL),
   dup AS (SELECT DISTINCT a FROM dots JOIN nn ON nn.page_id = a JOIN sn ON sn.article_id = b WHERE 25 * dot * dot >= 16 * nn.q * sn.q),
   ordered AS (SELECT *, CASE site WHEN 'blog' THEN 1 WHEN 'www' THEN 2 WHEN 'com' THEN 3 ELSE 4 END AS so FROM pg
               WHERE page_id NOT IN (SELECT a FROM dup)),
   firsts AS (SELECT *, row_number() OVER (PARTITION BY substring(title, 1, 500) ORDER BY so, page_id) AS rn FROM ordered),
   kept AS (SELECT * FROM firsts WHERE rn = 1 AND substring(title, 1, 500) NOT IN (SELECT substring(title, 1, 500) FROM catalogue))
   SELECT 'BB-' || ((SELECT max(CAST(substring(article_id, 4) AS BIGINT)) FROM catalogue) + row_number() OVER (ORDER BY so, page_id)) AS article_id,
          substring(title, 1, 500) AS title, substring(description, 1, 1000) AS description, substring(content, 1, 8000) AS content,
          '{DEFAULT_TS}' AS date_posted, author, url AS source_url, 'published' AS status, p.predicted AS type,
          '' AS image_urls, '' AS video_urls
   FROM kept JOIN pred p ON p.id = kept.page_id"""


def _every_second(spark, folder):
    return fx.articles(spark, folder).filter(F.expr("CAST(substring(article_id, 4) AS BIGINT) % 2 = 1"))


@query("d5_article_intake", INTAKE_SQL, "articles")
def d5(spark, folder):
    """Pages against a catalogue of every second article, of whatever status."""
    model = topics.fit(fx.table(spark, folder, "documents"), "text", "lang")
    stored = _every_second(spark, folder)
    rows = ingest(_pages(spark, folder), stored, model, _default_ts(), fx.page_sites())
    return rows.withColumn("date_posted", dates.stored_text(F.col("date_posted")))


HOSTS_SQL = "CASE site " + " ".join(f"WHEN '{name}' THEN '{page_ops.SITES[name].host}'" for name in SITE_NAMES) + " END"
PARAGRAPH = """'<p class="article-paragraph">'"""
FIGURE_SQL = """'<figure class="article-figure">' || chr(10) || '  <img src="https://img.test/' || doc_id || '.jpg" alt="' ||
   CASE WHEN site = 'vietnamnet' THEN 'a' ELSE '' END || '" class="article-image" />' || chr(10) ||
   CASE WHEN site = 'nld' THEN '  <figcaption class="article-caption">cap</figcaption>' || chr(10) ELSE '' END || '</figure>' || chr(10)"""

KNOWN_INTAKE_SQL = f"""WITH catalogue AS (SELECT * FROM articles WHERE CAST(substring(article_id, 4) AS BIGINT) % 2 = 1),
   known AS (SELECT *, {KNOWN_SQL} AS site FROM documents WHERE doc_id % 11 <> 0 AND doc_id % 2 = 1),
   parts AS (SELECT doc_id, string_split(text, chr(10)) AS part FROM known),
   lines AS (SELECT doc_id, i, {strip_sql('part[i]')} AS line FROM (SELECT doc_id, part, unnest(generate_series(1, len(part))) AS i FROM parts)),
   bodies AS (SELECT doc_id, string_agg({PARAGRAPH} || line || '</p>' || chr(10), '' ORDER BY i) AS body FROM lines GROUP BY doc_id),
   pg AS (SELECT k.doc_id AS page_id, k.site, k.doc_id % 6 AS so,
       CASE WHEN k.doc_id % 7 = 0 THEN 'No title' ELSE {strip_sql("split_part(k.text, chr(10), 1)")} END AS title,
       CASE WHEN k.doc_id % 5 = 0 THEN 'No description' ELSE {strip_sql("k.text")} END AS description,
       '<div class="article-contents">' || chr(10) || CASE WHEN site = 'vietnamplus' THEN fig || body ELSE body || fig END ||
         CASE WHEN site = 'tuoitre' THEN {PARAGRAPH} || '</p>' || chr(10)
              WHEN site = 'vnexpress' AND k.doc_id % 4 <> 0 THEN {PARAGRAPH} || 'An ' || k.doc_id || 'x</p>' || chr(10) ELSE '' END || '</div>' AS content,
       k.text || CASE WHEN site = 'nld' THEN ' cap' WHEN site IN ('vietnamnet', 'dantri') THEN ' [Image]'
                      WHEN site = 'vnexpress' AND k.doc_id % 4 <> 0 THEN ' An ' || k.doc_id || 'x' ELSE '' END AS plain_content,
       CASE WHEN k.doc_id % 3 = 0 THEN '{DEFAULT_TS}'
            ELSE strftime(make_timestamp(2025, 3, CAST(k.doc_id % 28 + 1 AS BIGINT), 9, 5, 0), '%Y-%m-%d %H:%M:%S') END AS date_posted,
       CASE WHEN k.doc_id % 4 = 0 THEN 'Unknown author' ELSE 'An ' || k.doc_id END AS author,
       'https://' || {HOSTS_SQL} || '/' || k.doc_id AS url
     FROM (SELECT *, {FIGURE_SQL} AS fig FROM known) k JOIN bodies b ON b.doc_id = k.doc_id),
   {model_sql(ALL_SQL)}, {scored_sql('SELECT page_id AS id, plain_content AS text FROM pg')},
   st AS (SELECT article_id, term, count(*) AS n FROM (SELECT article_id, unnest(regexp_extract_all(lower(content), '[@WORD]{{2,}}')) AS term FROM catalogue) GROUP BY ALL),
   nt AS (SELECT page_id, term, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(lower(content), '[@WORD]{{2,}}')) AS term FROM pg)
          WHERE term IN (SELECT term FROM st) GROUP BY ALL),
   sn AS (SELECT article_id, sum(n * n) AS q FROM st GROUP BY article_id), nn AS (SELECT page_id, sum(n * n) AS q FROM nt GROUP BY page_id),
   dots AS (SELECT nt.page_id AS a, st.article_id AS b, sum(nt.n * st.n) AS dot FROM nt JOIN st ON st.term = nt.term GROUP BY ALL),
   dup AS (SELECT DISTINCT a FROM dots JOIN nn ON nn.page_id = a JOIN sn ON sn.article_id = b WHERE 25 * dot * dot >= 16 * nn.q * sn.q),
   firsts AS (SELECT *, row_number() OVER (PARTITION BY substring(title, 1, 500) ORDER BY so, page_id) AS rn FROM pg
              WHERE page_id NOT IN (SELECT a FROM dup)),
   kept AS (SELECT * FROM firsts WHERE rn = 1 AND substring(title, 1, 500) NOT IN (SELECT substring(title, 1, 500) FROM catalogue))
   SELECT 'BB-' || ((SELECT max(CAST(substring(article_id, 4) AS BIGINT)) FROM catalogue) + row_number() OVER (ORDER BY so, page_id)) AS article_id,
          substring(title, 1, 500) AS title, substring(description, 1, 1000) AS description, substring(content, 1, 8000) AS content,
          date_posted, author, url AS source_url, 'published' AS status, p.predicted AS type,
          'https://img.test/' || page_id || '.jpg' || CASE WHEN site = 'tuoitre' THEN ',https://img.test/inline.jpg' ELSE '' END AS image_urls,
          'https://vid.test/' || page_id || '.mp4' AS video_urls
   FROM kept JOIN pred p ON p.id = kept.page_id"""


@query("d5_known_sites_intake", KNOWN_INTAKE_SQL, "articles")
def d5_known(spark, folder):
    """Every second document comes in as a page of one of the six sites; all others are stored, in two batches."""
    store = CatalogueStore(spark, shared_path(spark, "catalogue"))
    stored = _every_second(spark, folder)
    early = F.col("status") == "published"
    store.append(stored.filter(early), "first")
    store.append(stored.filter(~early), "second")
    crawled = _known_pages(spark, folder).filter(F.col("page_id") % 2 == 1)
    model = topics.fit(fx.table(spark, folder, "documents"), "text", "lang")
    rows = ingest_into(store, crawled, "third", model, _default_ts(), window=None)
    return rows.withColumn("date_posted", dates.stored_text(F.col("date_posted")))
