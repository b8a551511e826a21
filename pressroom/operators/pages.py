"""Articles and links out of crawled pages.

A task turns each page into plain facts (texts, blocks, attributes) by a rule table; everything
after that (site policies, rendering, defaults, dates, filters) is Column expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from pressroom.functions.dates import normalise_free, normalise_strict
from pressroom.functions.display import (
    NO_DESCRIPTION,
    NO_TITLE,
    UNKNOWN_AUTHOR,
    author_line,
    or_default,
)
from pressroom.functions.markup import Element, read_html
from pressroom.functions.text import strip
from pressroom.session import ship, spread

LIMIT_PER_SITE = 20


@dataclass(frozen=True)
class ListingRule:
    """How a site's list page is read. A path is a sequence of selectors, each inside the last."""

    containers: tuple[str, ...]
    item: str
    links: tuple[tuple[str, ...], ...]
    base: str
    prefix: str | None = None  # URLs that start with it are complete; None: always add the base
    holds: str | None = None  # the container must hold this
    titles: tuple[str, ...] = ("text",)  # in order: "text", "@title" or a selector
    time: tuple[str, ...] = ()
    thumbnail: tuple[str, ...] = ("img",)
    needs: tuple[str, ...] = ()  # of "thumbnail", "image", "no_media"
    media: tuple[tuple[str, ...], ...] = ()  # what counts as media
    time_default: str | None = None
    unique_urls: bool = False
    limit_before_filter: bool = False


@dataclass(frozen=True)
class SiteRule:
    """How a site's article page is read; the first alternative that exists wins."""

    host: str
    body: str
    title: tuple[tuple[str, ...], ...]
    description: tuple[tuple[str, ...], ...]
    author: tuple[tuple[str, ...], ...] = ()
    date: tuple[tuple[str, ...], ...] = ()
    drop: tuple[str, ...] = ()
    figures: str = "img"  # img | picture | lazy | photo, see ``rendered``
    author_in_body: bool = False
    strict_date: bool = False
    author_squashed: bool = True
    needs_text: bool = False
    listing: ListingRule | None = field(default=None, compare=False)


# Hosts, selectors, class names and limits of the six sites.
_H1_OR_TITLE = (("h1",), (".title",))
_H2_OR_DESCRIPTION = (("h2",), (".description",))

SITES: dict[str, SiteRule] = {
    "nld": SiteRule(
        host="nld.com.vn",
        title=_H1_OR_TITLE,
        description=_H2_OR_DESCRIPTION,
        body="div.detail-content.afcbc-body",
        author=((".author-info",),),
        date=((".date",),),
        listing=ListingRule(
            containers=("div.box-category-middle",),
            item="div.box-category-item",
            links=(("a",),),
            base="https://nld.com.vn",
            titles=("text", "@title"),
            time=("span.date",),
            time_default="Unknown",
            limit_before_filter=True,
        ),
    ),
    "vnexpress": SiteRule(
        host="vnexpress.net",
        title=(("h1.title-detail",),),
        description=(("p.description",),),
        body="article.fck_detail",
        author=(("p[style=text-align:right;]", "strong"), ("p[style=text-align:right;]",)),
        author_in_body=True,
        author_squashed=False,
        date=(("span.date",),),
        strict_date=True,
        listing=ListingRule(
            containers=("div.list-news-subfolder",),
            item="article.item-news",
            links=(("h3.title-news", "a"),),
            base="",
            titles=("@title", "text"),
            time=("span.time-count", "span"),
            time_default="Unknown",
            thumbnail=("div.thumb-art", "img"),
            needs=("thumbnail",),
        ),
    ),
    "vietnamnet": SiteRule(
        host="vietnamnet.vn",
        title=(("h1.content-detail-title",),),
        description=(("h2.content-detail-sapo",),),
        body="div.maincontent.main-content",
        drop=("div.ck-cms-insert-neww-group",),
        author=(("div[class=article-detail-author author-single]", "span.name"),),
        author_squashed=False,
        date=(("time",),),
        figures="picture",
        strict_date=True,
        listing=ListingRule(
            containers=("div.container__left",),
            holds="div.horizontalPost",
            item="div.horizontalPost",
            links=(
                ("div.horizontalPost__main", "h2.horizontalPost__main-title", "a"),
                ("div.horizontalPost__main", "h3.horizontalPost__main-title", "a"),
            ),
            base="https://vietnamnet.vn/",
            prefix="https://vietnamnet.vn/",
            unique_urls=True,
            limit_before_filter=True,
        ),
    ),
    "vietnamplus": SiteRule(
        host="vietnamplus.vn",
        title=(("h1",), (".article__title",)),
        description=(("div[class=article__sapo cms-desc]", "p"), ("div[class=article__sapo cms-desc]",)),
        body="div.article__body",
        drop=("div.article-relate", "div.article__source", "#sdaWeb_SdaArticleAfterBody"),
        author=(("div.article__meta", "span[class=author cms-author]"),),
        date=(("div.article__meta", "time.time"),),
        figures="photo",
        needs_text=True,
        listing=ListingRule(
            containers=("div#content-list", "div.content-list", "div.timeline"),
            item="article.story",
            links=(("h2.story__heading", "a.cms-link"),),
            base="https://www.vietnamplus.vn",
            prefix="http",
            titles=("@title", "strip"),
            time=("time.time",),
            media=(("h2.story__heading", "i.ic-audio"), ("h2.story__heading", "i.ic-video")),
            time_default="Unknown time",
            needs=("no_media",),
        ),
    ),
    "tuoitre": SiteRule(
        host="tuoitre.vn",
        title=_H1_OR_TITLE,
        description=_H2_OR_DESCRIPTION,
        body="div.detail-content.afcbc-body",
        author=(("div.detail-author",),),
        date=(("[data-role=publishdate]",),),
        listing=ListingRule(
            containers=("div#load-list-news.box-category-middle",),
            item="div.box-category-item",
            links=(("a.box-category-link-with-avatar",),),
            base="https://tuoitre.vn",
            titles=("@title",),
            limit_before_filter=True,
        ),
    ),
    "dantri": SiteRule(
        host="dantri.com.vn",
        title=(("h1.title-page",),),
        description=(("h2.singular-sapo",),),
        body="div.singular-content",
        drop=("div.box-taitro", "div.related-articles"),
        author=(("div.author-name",),),
        author_squashed=False,
        date=(("time.time",),),
        figures="lazy",
        strict_date=True,
        listing=ListingRule(
            containers=("div.article-newest",),
            item="article.article-newest-item",
            links=(("div.article-thumb", "a"), ("a",)),
            base="https://dantri.com.vn",
            prefix="https://dantri.com.vn",
            titles=("h2.article-title", "h3.article-title"),
            time=("div.article-time",),
            time_default="Unknown",
            thumbnail=("div.article-thumb", "img"),
            needs=("image",),
            unique_urls=True,
        ),
    ),
}

# Paragraphs stand beside the figures of the whole page only where figures are "photo".
_BLOCKS = ("p", "h2", "h3", "figure")

FACTS = """
    has_body boolean, raw_title string, raw_description string, raw_author string, raw_date string,
    blocks array<struct<
        tag: string, text: string, classes: array<string>, has_img: boolean, src: string,
        img_classes: array<string>, data_original: string, alt: string, srcset: string, caption: string
    >>,
    body_images array<string>, video_urls array<string>
"""

LINKS = """
    array<struct<
        position: int, title_text: string, title_attr: string, heading: string,
        href: string, time: string, has_thumbnail: boolean, image: string, has_media: boolean
    >>
"""


def route(url: Column, rules: Mapping[str, SiteRule]) -> Column:
    """Site of a URL: the first rule whose host occurs in it, NULL without one."""
    return F.coalesce(*[F.when(F.contains(url, F.lit(rule.host)), name) for name, rule in rules.items()])


def routed(pages: DataFrame, rules: Mapping[str, SiteRule] = SITES) -> DataFrame:
    return pages.withColumn("site", route(F.col("url"), rules)).filter(F.col("site").isNotNull())


def _at(node: Element, path: tuple[str, ...]) -> Element | None:
    for selector in path:
        node = None if node is None else node.find(selector)
    return node


def _first(node: Element, paths) -> Element | None:
    return next((found for path in paths if (found := _at(node, path)) is not None), None)


def _decided(node: Element, paths) -> Element | None:
    """The link of the first alternative whose holder exists, even if it holds no link."""
    for path in paths:
        holder = _at(node, path[:-1])
        if holder is not None:
            return holder.find(path[-1])
    return None


def _text(node: Element | None) -> str | None:
    return None if node is None else node.text()


def _block(node: Element) -> dict:
    if node.tag != "figure":
        return {"tag": node.tag, "text": node.stripped_text(), "classes": node.classes}
    img, caption, source = node.find("img"), node.find("figcaption"), _at(node, ("picture", "source"))
    attrs = img.attrs if img else {}
    return {
        "tag": "figure",
        "text": node.stripped_text(),
        "classes": node.classes,
        "has_img": img is not None,
        "src": attrs.get("src"),
        "img_classes": img.classes if img else [],
        "data_original": attrs.get("data-original"),
        "alt": attrs.get("alt", ""),
        "srcset": source.attrs.get("data-srcset") if source else None,
        "caption": caption.stripped_text() if caption else None,
    }


def page_facts(html: str, rule: SiteRule) -> dict:
    """The raw facts of one article page."""
    page = read_html(html)
    body = page.find(rule.body)
    if body is None:
        return {"has_body": False}
    for selector in rule.drop:
        body.remove(selector)
    nodes = [node for node in body.walk() if node.tag in _BLOCKS]
    if rule.figures == "photo":
        nodes = [*page.find_all("figure"), *[node for node in nodes if node.tag != "figure"]]
    return {
        "has_body": True,
        "raw_title": _text(_first(page, rule.title)),
        "raw_description": _text(_first(page, rule.description)),
        "raw_author": _text(_first(body if rule.author_in_body else page, rule.author)),
        "raw_date": date.stripped_text() if (date := _first(page, rule.date)) else None,
        "blocks": [_block(node) for node in nodes],
        "body_images": [n.attrs["src"] for n in body.find_all("img") if "src" in n.attrs],
        "video_urls": [n.attrs["src"] for n in page.find_all("video") if "src" in n.attrs],
    }


def listing_facts(html: str, rule: ListingRule) -> list[dict]:
    """The items of one list page, in order, with what the filters need to know."""
    page = read_html(html)
    boxes = (box for selector in rule.containers for box in page.find_all(selector))
    box = next((b for b in boxes if rule.holds is None or b.find(rule.holds)), None)
    items = []
    for position, node in enumerate(box.find_all(rule.item) if box else (), 1):
        link, image = _decided(node, rule.links), _at(node, rule.thumbnail)
        holder = _at(node, rule.thumbnail[:1])
        if image is None and holder is None:
            image = node.find("img") if "image" in rule.needs else None
        heading_link = _decided(node, [(selector, "a") for selector in rule.titles if "." in selector])
        media = any(_at(node, path) is not None for path in rule.media)
        items.append(
            {
                "position": position,
                "title_text": _text(link),
                "title_attr": link.attrs.get("title") if link else None,
                "heading": _text(heading_link),
                "href": link.attrs.get("href") if link else None,
                "time": _text(_at(node, rule.time)) if rule.time else None,
                "has_thumbnail": holder is not None,
                "image": image.attrs.get("src") if image else None,
                "has_media": media,
            }
        )
    return items


def _per_page(pages: DataFrame, key: str, facts, schema: str) -> DataFrame:
    """Run ``facts(html, site) -> dict`` over Arrow batches of pages."""
    ship(pages.sparkSession)
    names = T.StructType.fromDDL(schema).names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [facts(html, site) for html, site in zip(batch["html"], batch["site"])]
            yield pd.DataFrame(
                {
                    key: batch[key],
                    "site": batch["site"],
                    "url": batch["url"],
                    **{name: [row.get(name) for row in rows] for name in names},
                }
            )

    id_type = pages.schema[key].dataType.simpleString()
    ready = pages.filter(F.col("html").isNotNull()).select(key, "site", "url", "html")
    return spread(ready).mapInPandas(run, f"{key} {id_type}, site string, url string, {schema}")


def _flag(rules: Mapping[str, SiteRule], test) -> Column:
    """Whether the row's site has a rule property."""
    return F.col("site").isin([name for name, rule in rules.items() if test(rule)])


def extract_facts(pages: DataFrame, rules: Mapping[str, SiteRule] = SITES, key: str = "page_id") -> DataFrame:
    """Routed pages → raw facts; pages without a body are dropped."""
    table = dict(rules)
    facts = _per_page(routed(pages, rules), key, lambda html, site: page_facts(html, table[site]), FACTS)
    return facts.filter("has_body").drop("has_body")


def image_source(block: Column, rules: Mapping[str, SiteRule]) -> Column:
    """URL of a figure's image by the site's figure policy; NULL when the figure shows none."""
    src, srcset = block["src"], block["srcset"]
    lazy = F.coalesce(strip(block["data_original"]), strip(F.split_part(src, F.lit(","), F.lit(1))))
    photo = F.array_contains(block["img_classes"], "cms-photo") & F.startswith(src, F.lit("http"))
    chosen = (
        F.when(_flag(rules, lambda r: r.figures == "img"), src)
        .when(_flag(rules, lambda r: r.figures == "picture"), F.split_part(strip(srcset), F.lit(" "), F.lit(1)))
        .when(_flag(rules, lambda r: r.figures == "lazy"), lazy)
        .when(_flag(rules, lambda r: r.figures == "photo") & photo, src)
    )
    return F.when(_flag(rules, lambda r: r.figures == "img"), chosen).otherwise(F.nullif(chosen, F.lit("")))


def is_figure(block: Column, rules: Mapping[str, SiteRule]) -> Column:
    """Where figures are "lazy", only centred image figures count; others are paragraphs."""
    centred = F.array_contains(block["classes"], "image") & F.array_contains(block["classes"], "align-center")
    return (block["tag"] == "figure") & (~_flag(rules, lambda r: r.figures == "lazy") | centred)


def plain_text(rules: Mapping[str, SiteRule]) -> Column:
    """One line per block; a figure gives its caption or the literal ``[Image] ``."""
    named = _flag(rules, lambda r: r.figures in ("picture", "lazy"))

    def line(block):
        figure = F.when(named, F.lit("[Image] ")).otherwise(
            F.coalesce(F.concat(block["caption"], F.lit("\n")), F.lit(""))
        )
        return F.when(is_figure(block, rules), figure).otherwise(F.concat(block["text"], F.lit("\n")))

    return F.array_join(F.transform("blocks", line), "")


def html_text(rules: Mapping[str, SiteRule]) -> Column:
    """Normalised HTML with the ``article-*`` classes."""
    photo = _flag(rules, lambda r: r.figures == "photo")

    def element(block):
        src = image_source(block, rules)
        shown = F.when(_flag(rules, lambda r: r.figures == "img"), block["has_img"]).otherwise(src.isNotNull())
        opened = F.concat(
            F.lit('<figure class="article-figure">\n  <img src="'),
            F.coalesce(src, F.lit("")),
            F.lit('" alt="'),
            F.coalesce(block["alt"], F.lit("")),
            F.lit('" class="article-image" />\n'),
        )
        caption = F.concat(
            F.lit('  <figcaption class="article-caption">'), block["caption"], F.lit("</figcaption>\n")
        )
        figure = F.concat(
            F.when(shown, opened).otherwise(""),
            F.coalesce(caption, F.lit("")),
            F.when(shown, "</figure>\n").otherwise(""),
        )
        refused = photo & block["has_img"] & src.isNull()
        heading = F.concat(
            F.lit("<"), block["tag"], F.lit(' class="article-subheading">'), block["text"],
            F.lit("</"), block["tag"], F.lit(">\n"),
        )
        paragraph = F.concat(F.lit('<p class="article-paragraph">'), block["text"], F.lit("</p>\n"))
        return (
            F.when(is_figure(block, rules), F.when(refused, "").otherwise(figure))
            .when(block["tag"].isin("h2", "h3"), heading)
            .otherwise(paragraph)
        )

    return F.concat(
        F.lit('<div class="article-contents">\n'),
        F.array_join(F.transform("blocks", element), ""),
        F.lit("</div>"),
    )


def image_urls(rules: Mapping[str, SiteRule]) -> Column:
    """All body images, or only those of shown figures, by the site's policy; repeats stay."""
    shown = F.filter(
        F.transform(F.filter("blocks", lambda b: is_figure(b, rules)), lambda b: image_source(b, rules)),
        lambda src: src.isNotNull(),
    )
    return F.when(_flag(rules, lambda r: r.figures == "img"), F.col("body_images")).otherwise(shown)


def rendered(
    facts: DataFrame,
    default_ts: Column,
    rules: Mapping[str, SiteRule] = SITES,
    compat: bool = False,
) -> DataFrame:
    """Raw facts → article fields. Pages a site's rules refuse are dropped."""
    broken = _flag(rules, lambda r: r.figures == "img") & F.exists(
        "blocks", lambda b: (b["tag"] == "figure") & b["has_img"] & b["src"].isNull()
    )
    blank = _flag(rules, lambda r: r.needs_text) & (strip(F.col("plain_content")) == "")
    author = F.when(_flag(rules, lambda r: r.author_squashed), author_line(F.col("raw_author"))).otherwise(
        strip(F.col("raw_author"))
    )
    date = F.when(
        _flag(rules, lambda r: r.strict_date), normalise_strict(F.col("raw_date"), default_ts, compat)
    ).otherwise(normalise_free(F.col("raw_date"), default_ts))
    key_columns = facts.columns[:3]
    return (
        facts.filter(~broken)
        .withColumn("plain_content", plain_text(rules))
        .filter(~blank)
        .select(
            *key_columns,
            or_default(strip(F.col("raw_title")), NO_TITLE).alias("title"),
            or_default(strip(F.col("raw_description")), NO_DESCRIPTION).alias("description"),
            html_text(rules).alias("content"),
            "plain_content",
            F.to_timestamp(date).alias("date_posted"),
            or_default(author, UNKNOWN_AUTHOR).alias("author"),
            F.col("url").alias("source_url"),
            F.lit("published").alias("status"),
            image_urls(rules).alias("image_urls"),
            "video_urls",
        )
    )


def extract_articles(
    pages: DataFrame,
    default_ts: Column,
    rules: Mapping[str, SiteRule] = SITES,
    key: str = "page_id",
    compat: bool = False,
) -> DataFrame:
    return rendered(extract_facts(pages, rules, key), default_ts, rules, compat)


def extract_links(pages: DataFrame, rules: Mapping[str, SiteRule] = SITES, key: str = "page_id") -> DataFrame:
    """Every item of every list page, before filters and limits."""
    return _link_lists(pages, rules, key).select(key, "site", F.col("url").alias("list_url"), F.inline("links"))


def _link_lists(pages: DataFrame, rules: Mapping[str, SiteRule], key: str) -> DataFrame:
    """The items of each list page as one array."""
    table = {name: rule.listing for name, rule in rules.items() if rule.listing}
    wanted = routed(pages, rules).filter(F.col("site").isin(list(table)))
    return _per_page(wanted, key, lambda html, site: {"links": listing_facts(html, table[site])}, f"links {LINKS}")


def absolute_url(rules: Mapping[str, SiteRule], get: Callable[[str], Column] = F.col) -> Column:
    """Add the site's base unless the link is complete by the site's rule."""
    href, cases = get("href"), []
    for name, rule in rules.items():
        if rule.listing:
            joined = F.concat(F.lit(rule.listing.base), href)
            if rule.listing.prefix:
                whole = F.startswith(href, F.lit(rule.listing.prefix))
                joined = F.when(whole, href).otherwise(joined)
            cases.append(F.when(F.col("site") == name, joined))
    return F.coalesce(*cases)


def _listing_flag(rules, test) -> Column:
    return _flag(rules, lambda rule: rule.listing is not None and test(rule.listing))


def accepted(rules: Mapping[str, SiteRule], get: Callable[[str], Column] = F.col) -> Column:
    """Whether an item passes its site's filters; every site needs a link."""
    blank = F.coalesce(strip(get("href")), F.lit("")) == ""
    return (
        get("href").isNotNull()
        & ~(_listing_flag(rules, lambda r: "no_media" in r.needs) & (get("has_media") | blank))
        & ~(_listing_flag(rules, lambda r: "thumbnail" in r.needs) & ~get("has_thumbnail"))
        & ~(_listing_flag(rules, lambda r: "image" in r.needs) & get("image").isNull())
    )


def link_title(rules: Mapping[str, SiteRule]) -> Column:
    """Title by the site's order of preference, else the placeholder."""
    text, attr = strip(F.col("title_text")), F.col("title_attr")
    shown = F.nullif(text, F.lit(""))
    by_order = {
        ("text",): text,
        ("text", "@title"): F.coalesce(shown, attr),
        ("@title", "text"): F.when(shown.isNotNull(), F.coalesce(attr, text)),
        ("@title",): attr,
        ("@title", "strip"): strip(attr),
    }
    cases = []
    for name, rule in rules.items():
        if rule.listing:
            title = by_order.get(rule.listing.titles, strip(F.col("heading")))
            cases.append(F.when(F.col("site") == name, title))
    return F.coalesce(*cases, F.lit(NO_TITLE))


def time_default(rules: Mapping[str, SiteRule]) -> Column:
    """Text for a missing time, for the sites that show one."""
    named = [(name, rule.listing.time_default) for name, rule in rules.items() if rule.listing]
    return F.coalesce(
        *[F.when(F.col("site") == name, text) for name, text in named if text], F.lit(None).cast("string")
    )


def listing(
    pages: DataFrame,
    rules: Mapping[str, SiteRule] = SITES,
    limit: int | None = LIMIT_PER_SITE,
    key: str = "page_id",
) -> DataFrame:
    """Links of the list pages: filters, one item per URL where asked, the first ``limit`` of each page.

    ``limit`` None keeps all. A page's links are one array, so nothing is shuffled.
    """
    lists = _link_lists(pages, rules, key)
    whole = F.transform("links", lambda x: x.withField("url", absolute_url(rules, x.getField)))
    early = _listing_flag(rules, lambda r: r.limit_before_filter)
    unique = _listing_flag(rules, lambda r: r.unique_urls)

    def cut(items: Column) -> Column:
        return F.slice(items, 1, limit) if limit is not None else items

    lists = lists.withColumn("links", whole)
    lists = lists.withColumn("links", F.when(early, cut(F.col("links"))).otherwise(F.col("links")))
    lists = lists.withColumn("links", F.filter("links", lambda x: accepted(rules, x.getField)))
    urls = F.transform("links", lambda x: x["url"])
    lists = lists.withColumn("urls", urls)
    firsts = F.filter("links", lambda x, i: F.array_position("urls", x["url"]) == i + 1)
    lists = lists.withColumn("links", F.when(unique, firsts).otherwise(F.col("links")))
    kept = lists.select(key, "site", F.inline(F.when(early, F.col("links")).otherwise(cut(F.col("links")))))
    return kept.select(
        key,
        "site",
        "position",
        link_title(rules).alias("title"),
        "url",
        F.coalesce(strip(F.col("time")), time_default(rules)).alias("date_posted"),
        F.col("image").alias("image_url"),
    )


def union_sites(frames: list[DataFrame]) -> DataFrame:
    """One frame of all sites' rows; fields a site lacks are NULL, repeats stay."""
    return reduce(lambda one, other: one.unionByName(other, allowMissingColumns=True), frames)
