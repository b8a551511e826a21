"""Main text of HTML pages by consensus of each host.

1. Block texts that recur on the pages of a host are counted in Spark. A text on at least half of a host's
   pages, and on ``LEAST_PAGES``, recurs: menus, teasers, notices, whatever their classes.
2. Each page is read into a light tree of its block elements and every container is scored: the text below it
   that may be the article, a little less what stands beside it there. What counts as beside: tags and roles
   for menus, forms and the like; elements of which nearly all text recurs or, outside an article, is
   links; and elements named by their class as adverts, comments and so on. The path of the best
   container - tags with classes, numbers generalised - is a vote.
3. Votes are counted per host in Spark (pages, then characters, then the path itself).
4. Every page is read again, and the text is taken from the elements on the host's winning path, without what
   stands beside the article; a page without such an element uses its own best container.

Inside an article or main element, and inside the smallest element with half of the page's text, a class name
that only contains such a word removes nothing without links or recurrence to prove it: a section
``social-policy`` is text, ``comment-list`` is not.

Winners are one row a host, with at most twice as many recurring texts as its pages have blocks; the join is a
broadcast if Spark sees that the table is small, else a shuffle in which a hot host can be split.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressroom.llm.common import attach, settle

# Fixed names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp svg math template select".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav noscript ol p pre search section "
    "summary table tbody td tfoot th thead tr ul button label object video audio canvas".split()
)
CLOSES_P = BLOCK - {"html", "head", "body", "button", "label", "object", "video", "audio", "canvas", "noscript"}
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
AWAY_TAGS = frozenset("nav footer aside form head dialog menu button label noscript object video audio canvas search fieldset".split())
AWAY_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs header masthead footer sidebar aside cookie cookies consent gdpr notice notices popup modal overlay "
    "subscribe subscription newsletter share sharing social related recommended comment comments disqus respond replies "
    "login signup widget toolbar pagination".split()
)
# Of these, names that no part of an article has, alone or with words that only tell its place or form.
STRONG_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsored comment comments disqus respond replies share sharing newsletter "
    "subscribe subscription cookie cookies breadcrumb breadcrumbs pagination login signup".split()
)
PLACE_WORDS = frozenset(
    "list area section box container wrapper wrap slot block button buttons bar form unit inner outer thread item items link links "
    "top bottom left right count".split()
)
AWAY_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
KEPT_TAGS = frozenset(("html", "body", "main", "article"))

# Elements that are a piece of running text: never beside the article by what they hold alone.
PIECES = frozenset("p h1 h2 h3 h4 h5 h6 hgroup li dt dd td th tr tbody thead tfoot caption pre blockquote figure figcaption address".split()) | KEPT_TAGS
HEADINGS = frozenset(("h1", "h2"))
CELLS = frozenset("td th tr tbody".split())  # may lay out the page, outside the article
LEAST_PAGES = 3
RECURRING, LINKED = 0.8, 0.6  # share of recurring text, and of links, from which an element stands beside the article
HEADING_WORTH, BESIDE_COST = 200, 0.02  # characters that a heading counts for, and what text beside the article costs

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden)(?=[\s=/>]|$)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_DIGITS = re.compile(r"\d+")


@dataclass(slots=True)
class Element:
    tag: str
    path: str
    parent: Element | None
    named: int  # 3 by tag, role or hidden; 2 by a class name of STRONG_WORDS, 1 by one that holds a word; else 0
    in_article: bool
    away: bool = False
    chars: int = 0  # of all text below
    links: int = 0  # of it inside links
    known: int = 0  # of it recurring
    good: int = 0  # of it possibly the article
    beside: int = 0
    worth: int = 0  # good, and what headings count for
    children: list[Element] = field(default_factory=list)
    blocks: list[tuple[int, str, int]] = field(default_factory=list)  # (place in the page, text, characters in links)


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTRIBUTE.finditer(text)} if text.strip(" /") else {}


def _named(tag: str, attributes: dict[str, str]) -> int:
    if tag in KEPT_TAGS:
        return 0
    if tag in AWAY_TAGS or attributes.get("role", "").lower() in AWAY_ROLES:
        return 3
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return 3
    most = 0
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split():
        parts = [part for part in re.split(r"[-_:]+", name) if part]
        if not parts or parts[0] in ("has", "with", "no", "without"):
            continue
        plain = [_DIGITS.sub("", part) for part in parts]
        if any(part in STRONG_WORDS for part in plain) and all(part in AWAY_WORDS | PLACE_WORDS | {""} for part in plain):
            return 2
        if parts[-1] in AWAY_WORDS or parts[0] in AWAY_WORDS:
            most = 1
    return most


def read(page: str) -> Element:
    """The tree of block elements. Linear in the page; broken markup is read as browsers do, roughly."""
    root = Element("", "", None, 0, False)
    stack, words, link, place = [root], [], False, 0
    linked = 0

    def flush() -> None:
        nonlocal words, linked, place
        if words:
            text = " ".join("".join(words).split())
            if text:
                stack[-1].blocks.append((place, text, min(linked, len(text))))
                place += 1
        words, linked = [], 0

    def close(tags: set[str] | frozenset[str], borders: set[str] | frozenset[str] = frozenset()) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                flush()
                del stack[i:]
                return
            if stack[i].tag in borders:
                return

    at, n = 0, len(page)
    while at < n:
        start = page.find("<", at)
        if start < 0:
            start = n
        if start > at:
            text = entities.unescape(page[at:start])
            words.append(text)
            linked += len(text) if link else 0
        if start >= n:
            break
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), start):
            end = page.find(">", start)
            at = n if end < 0 else end + 1
            continue
        ending = page.startswith("</", start)
        name = _NAME.match(page, start + 1 + ending)
        if not name:
            if ending:  # a bogus comment
                end = page.find(">", start)
                at = n if end < 0 else end + 1
            else:
                words.append("<")
                at = start + 1
            continue
        rest = _REST.match(page, name.end())
        stop = rest.end() if rest else page.find(">", name.end()) + 1 or n
        tag = name.group().lower()
        at = stop
        if tag == "br":
            words.append(" ")
        elif tag == "a":
            link = not ending
        elif ending:
            if tag in BLOCK:
                link = False
                flush()
                close({tag}, frozenset() if tag in ("html", "body", "table") else {"td", "th", "table"} - {tag})
        elif tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, stop) if tag != "svg" or not page[stop - 2 : stop] == "/>" else None
            if tag not in ("svg", "math") or end:
                at = n if end is None else (page.find(">", end.end()) + 1 or n)
        elif tag == "hr":
            flush()
        elif tag in BLOCK and tag not in VOID:
            link = False
            flush()
            if tag in CLOSES_P:
                close({"p"}, {"td", "th", "table", "button"})
            if tag in SIBLINGS:
                close(*SIBLINGS[tag])
            if tag[0] == "h" and tag[1:].isdigit():
                close({"h1", "h2", "h3", "h4", "h5", "h6"}, BLOCK - {"h1", "h2", "h3", "h4", "h5", "h6"})
            up = stack[-1]
            attributes = _attributes(page[name.end() : stop - 1])
            # Classes of the whole page differ from page to page and say nothing about the container.
            classes = "" if tag in ("html", "body") else ".".join(sorted(_DIGITS.sub("0", attributes.get("class", "").lower()).split()))
            if not classes and attributes.get("id") and tag not in ("html", "body"):
                classes = "#" + _DIGITS.sub("0", attributes["id"].lower())
            inside = up.in_article or up.tag in ("article", "main")
            named = 3 if tag == "header" and not inside else _named(tag, attributes)
            element = Element(tag, f"{up.path}/{tag}{'.' * bool(classes)}{classes}" if len(stack) < 64 else up.path, up, named, inside)
            up.children.append(element)
            stack.append(element)
    flush()
    return root


def _in_order(root: Element) -> list[Element]:
    """All elements, each before those inside it."""
    found, open_ = [], [root]
    while open_:
        element = open_.pop()
        found.append(element)
        open_ += reversed(element.children)
    return found


def text_number(text: str) -> int:
    """Number that stands for a block's text."""
    import xxhash

    return xxhash.xxh3_64_intdigest(text.lower()) - (1 << 63)


def judge(root: Element, recurring: frozenset[int] = frozenset()) -> list[Element]:
    """Fill in the measures of all elements, and return them, each before those inside it.

    Recurring texts count only if they are not most of the page: on copies of one page everything recurs.
    """
    elements = _in_order(root)
    for e in reversed(elements):
        for _, text, links in e.blocks:
            e.chars += len(text)
            e.links += links
            e.known += len(text) if recurring and text_number(text) in recurring else 0
        if e.parent is not None:
            e.parent.chars += e.chars
            e.parent.links += e.links
            e.parent.known += e.known
    whole = sum(e.chars for e in elements if e.named == 3 and (e.parent is None or e.parent.named < 3))
    trusted = 2 * root.known <= max(1, root.chars) or 2 * (root.known - whole) <= root.chars - whole

    def proven(e: Element, inside: bool) -> bool:
        """By what it holds: recurring text, or links."""
        if (e.tag in PIECES and (inside or e.tag not in CELLS)) or not e.chars:
            return False
        linked = e.links >= LINKED * e.chars and (not inside or e.named)
        return linked or (trusted and e.known >= RECURRING * e.chars)

    def place(core: Element | None) -> None:
        within = set()
        for e in elements:
            if e.parent is not None and (e.parent is core or id(e.parent) in within):
                within.add(id(e))
            inside = e.in_article or id(e) in within
            # A name outside says enough, unless the element holds most of the page.
            by_name = e.named == 1 and not inside and 2 * e.chars < root.chars
            e.away = (e.parent is not None and e.parent.away) or e.named >= 2 or by_name or proven(e, inside)
            e.good = e.beside = e.worth = 0
        for e in reversed(elements):
            own = sum(len(text) for _, text, _ in e.blocks)
            e.good += 0 if e.away else own
            e.beside += own if e.away else 0
            e.worth += 0 if e.away else own + HEADING_WORTH * (e.tag in HEADINGS and own > 0)
            if e.parent is not None:
                e.parent.good += e.good
                e.parent.beside += e.beside
                e.parent.worth += e.worth

    place(None)
    core = None
    for e in elements:  # the last one is the smallest: elements with half of the text lie in one another
        if e.good and 2 * e.good >= root.good and e.tag not in PIECES - KEPT_TAGS - CELLS:
            core = e
    place(core)
    return elements


def own_container(elements: list[Element]) -> Element | None:
    """The container with the best score, of equal ones the innermost, not below an article or main element; None
    for a page without text. ``elements`` as ``judge`` returns them."""
    best, most = None, 0.0
    for e in elements:
        if e.good and not e.away and not e.in_article and e.tag not in PIECES - KEPT_TAGS - CELLS:
            score = e.worth - BESIDE_COST * e.beside
            if best is None or score >= most:
                best, most = e, score
    return best


def on_path(root: Element, path: str) -> list[Element]:
    """Topmost elements with that path that are not beside the article."""
    found, open_ = [], [root]
    while open_:
        element = open_.pop()
        if element.away:
            continue
        if element.path == path:
            found.append(element)
        elif path.startswith(element.path):
            open_ += element.children
    return found


def text_of(elements: list[Element]) -> str:
    blocks, open_ = [], list(elements)
    while open_:
        element = open_.pop()
        if not element.away:
            blocks += element.blocks
            open_ += element.children
    return "\n".join(text for _, text, _ in sorted(blocks))


def main_text(page: str | None, path: str | None, recurring: frozenset[int]) -> str:
    """The text of one page, given what its host has voted for."""
    root = read(page or "")
    elements = judge(root, recurring)
    chosen = on_path(root, path) if path else []
    if not any(e.good for e in chosen):
        own = own_container(elements)
        chosen = [own] if own else []
    return text_of(chosen)


def host_of(url) -> F.Column:
    """Host in lower case, without user and port; empty for NULL and for what is no URL."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def recurring_texts(pages: DataFrame) -> DataFrame:
    """(host, recurring): numbers of the block texts that recur on the pages (host, html) of each host."""

    def kernel(column: pa.Array) -> dict[str, list]:
        out = []
        for page in column.to_pylist():
            texts = {text for e in _in_order(read(page or "")) for _, text, _ in e.blocks}
            out.append(sorted(map(text_number, texts)))
        return {"texts": out}

    found = attach(pages, ["html"], kernel, "texts array<bigint>", "t", keep=["host"])
    counted = found.select("host", F.explode("t.texts").alias("number")).groupBy("host", "number").agg(F.count("*").alias("n"))
    # The pages of a host are counted beside the kernel: a second use of its rows would read every page again.
    sizes = pages.groupBy(F.col("host").alias("of")).agg(F.count("*").alias("pages"))
    many = counted.where(F.col("n") >= LEAST_PAGES).join(sizes, F.col("host") == F.col("of"))
    return many.where(2 * F.col("n") >= F.col("pages")).groupBy("host").agg(F.collect_set("number").alias("recurring"))


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the path most pages of a host vote for. ``pages``: host, html, recurring."""

    def kernel(column: pa.Array, known: pa.Array) -> dict[str, list]:
        paths, sizes = [], []
        for page, numbers in zip(column.to_pylist(), known.to_pylist()):
            best = own_container(judge(read(page or ""), frozenset(numbers or ())))
            paths.append(best.path if best else None)
            sizes.append(best.good if best else 0)
        return {"path": paths, "size": sizes}

    votes = attach(pages, ["html", "recurring"], kernel, "path string, size bigint", "v", keep=["host"])
    counted = votes.where("v.path is not null").groupBy("host", F.col("v.path").alias("path")).agg(
        F.count("*").alias("pages"), F.sum("v.size").alias("size")
    )
    return counted.groupBy("host").agg(F.max_by("path", F.struct("pages", "size", "path")).alias("path"))


def extract(pages: DataFrame) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars.

    Blocks are joined by one line feed, white space inside a block is one space. NULL and empty pages
    have an empty text; repeated rows are repeated; pages without a URL are one host.
    """
    rows = pages.select("page_id", "url", "html").withColumn("host", host_of(F.col("url")))
    recurring = settle(recurring_texts(rows.select("host", "html")), "host-texts")
    known = rows.join(recurring, "host", "left")
    winners = settle(winning_paths(known.select("host", "html", "recurring")), "host-paths")
    joined = known.join(winners, "host", "left")

    def kernel(column: pa.Array, paths: pa.Array, known: pa.Array) -> dict[str, list]:
        texts = [
            main_text(page, path, frozenset(numbers or ()))
            for page, path, numbers in zip(column.to_pylist(), paths.to_pylist(), known.to_pylist())
        ]
        return {"text": texts, "n_chars": [len(t) for t in texts]}

    return attach(joined, ["html", "path", "recurring"], kernel, "text string, n_chars bigint", "t", keep=["page_id", "url"]).select("page_id", "url", "t.*")
