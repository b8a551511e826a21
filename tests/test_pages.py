"""Page extraction: the six sites, malformed markup, list pages."""

import pytest
from pyspark.sql import functions as F

from pressroom.functions.markup import read_html
from pressroom.operators import pages

DEFAULT = "2024-01-01 00:00:00"


def extract(spark, rows, rules=pages.SITES, compat=False):
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    result = pages.extract_articles(frame, F.lit(DEFAULT).cast("timestamp"), rules, compat=compat)
    return {r.page_id: r for r in result.collect()}


def test_markup_reader_is_lenient():
    root = read_html('<div class="a b" id=x><p>one<p>two</p></i> three<script>var t="</p>";</script><br/>&amp; four</div>tail')
    outer = root.find("p")
    assert outer.text() == "onetwo three& four"
    assert [p.stripped_text() for p in root.find_all("p")] == ["onetwothree& four", "two"]
    assert root.find("div#x.b[class=a b]") is root.find("div.a.b") is not None
    assert root.find("div[class=b a]") is None and root.find(".c") is None
    root.remove("p")
    assert root.text() == "tail"


def test_deeply_nested_markup_is_read():
    root = read_html("<p>" * 20_000 + "x")
    assert root.text() == "x" and sum(1 for _ in root.find_all("p")) == 20_000


BODY = ("<p> Một <b>hai</b> </p><h2>Mục</h2><figure><img src='https://i/1.jpg' alt='A'><figcaption> chú thích </figcaption></figure>"
        "<figure><figcaption>chỉ chữ</figcaption></figure>")
NLD_HTML = (
    '<div class="article-contents">\n<p class="article-paragraph">Mộthai</p>\n<h2 class="article-subheading">Mục</h2>\n'
    '<figure class="article-figure">\n  <img src="https://i/1.jpg" alt="A" class="article-image" />\n'
    '  <figcaption class="article-caption">chú thích</figcaption>\n</figure>\n'
    '  <figcaption class="article-caption">chỉ chữ</figcaption>\n</div>'
)


def nld(body=BODY, head="<h1> T </h1><h2>D</h2>", tail="<span class='date'>19/03/2025 19:54 GMT+7</span><div class='author-info'> An \n Bình </div>"):
    return f"{head}<div class='detail-content afcbc-body'>{body}</div>{tail}<video src='v.mp4'></video><video></video>"


def test_plain_and_html_rendering(spark):
    row = extract(spark, [(1, "https://nld.com.vn/a", nld())])[1]
    assert row.title == "T" and row.description == "D" and row.author == "An Bình" and row.status == "published"
    assert row.plain_content == "Mộthai\nMục\nchú thích\nchỉ chữ\n"
    assert row.content == NLD_HTML
    assert (row.image_urls, row.video_urls) == (["https://i/1.jpg"], ["v.mp4"])
    assert str(row.date_posted) == "2025-03-19 19:54:00" and row.source_url == "https://nld.com.vn/a"


def test_refused_and_defaulted_pages(spark):
    rows = [
        (1, "https://nld.com.vn/no-body", "<h1>T</h1>"),
        (2, "https://nld.com.vn/img-without-src", nld("<figure><img alt='x'></figure>")),
        (3, "https://nld.com.vn/bare", nld("<p>x</p>", head="", tail="")),
        (4, "https://elsewhere.test/a", nld()),
        (5, "https://www.vietnamplus.vn/blank", "<div class='article__body'><p> </p></div>"),
        (6, "https://nld.com.vn/null", None),
    ]
    got = extract(spark, rows)
    assert sorted(got) == [3]
    assert (got[3].title, got[3].description, got[3].author) == ("No title", "No description", "Unknown author")
    assert str(got[3].date_posted) == DEFAULT


def test_site_policies(spark):
    rows = [
        (1, "https://vnexpress.net/a",
         "<h1>other</h1><h1 class='title-detail'>T</h1><article class='fck_detail'><p>x</p><p style='text-align:right;'>Theo <strong> An </strong></p></article>"
         "<p style='text-align:right;'><strong>không</strong></p><span class='date'>Thứ sáu, 19/3/2025, 19:54 (GMT+7)</span>"),
        (2, "https://vietnamnet.vn/a",
         "<div class='maincontent main-content'><div class='ck-cms-insert-neww-group'><p>ad</p></div><p>x</p>"
         "<figure><picture><source data-srcset=' https://i/2.jpg 2x, y'></picture><img alt='B' src='z'></figure><figure><img src='q.jpg'></figure></div>"
         "<div class='article-detail-author author-single'><span class='name'>An</span></div><time>Chủ nhật, 2/3/2025, 1:00 (GMT+7)</time>"),
        (3, "https://www.vietnamplus.vn/a",
         "<figure><img class='cms-photo' src='https://i/top.jpg'></figure><div class='article__sapo cms-desc'><p> D </p></div>"
         "<div class='article__body'><div class='article-relate'><figure><img class='cms-photo' src='https://i/no.jpg'></figure></div><p>x</p>"
         "<figure><img src='https://i/plain.jpg'><figcaption>c</figcaption></figure><figure><img class='cms-photo' src='/rel.jpg'></figure></div>"
         "<div class='article__meta'><span class='author cms-author'>An  B</span><time class='time'>19-03-2025 08:00 GMT+7</time></div>"),
        (4, "https://dantri.com.vn/a",
         "<div class='singular-content'><figure class='image align-center'><img data-original=' https://i/4.jpg ' src='s'></figure>"
         "<figure class='image align-center'><img src='https://i/5.jpg, z'></figure><figure class='video'>clip</figure><div class='related-articles'><p>r</p></div></div>"
         "<div class='author-name'> An </div>"),
        (5, "https://tuoitre.vn/a", "<div class='detail-content afcbc-body'><p>x<img src='in.jpg'></p></div><div class='detail-author'>An</div><div data-role='publishdate'>4/3/2025 07:08 GMT+7</div>"),
    ]
    got = extract(spark, rows, compat=True)
    assert (got[1].title, got[1].author, str(got[1].date_posted)) == ("T", "An", "2025-03-19 19:54:00")
    assert got[2].plain_content == "x\n[Image] [Image] " and got[2].image_urls == ["https://i/2.jpg"] and got[2].author == "An"
    assert str(got[2].date_posted) == DEFAULT  # the compatible rule cannot read this weekday
    assert str(extract(spark, rows)[2].date_posted) == "2025-03-02 01:00:00"
    assert got[3].image_urls == ["https://i/top.jpg"] and got[3].plain_content == "c\nx\n" and got[3].description == "D"
    assert got[3].content.count("<figure") == 1 and "figcaption" not in got[3].content and got[3].author == "An B"
    assert got[4].image_urls == ["https://i/4.jpg", "https://i/5.jpg"] and got[4].plain_content == "[Image] [Image] clip\n"
    assert got[5].image_urls == ["in.jpg"] and str(got[5].date_posted) == "2025-03-04 07:08:00"


LISTS = {
    "https://nld.com.vn/tin-24h.htm":
        "<div class='box-category-middle'>" + "".join(
            f"<div class='box-category-item'><a href='/n{i}'>{' N%d ' % i if i else ''}</a><span class='date'>1h</span><img src='i{i}'></div>" for i in range(4)) + "</div>",
    "https://vnexpress.net/tin-tuc-24h":
        "<div class='list-news-subfolder'><article class='item-news'><h3 class='title-news'><a href='https://vnexpress.net/1'>no thumb</a></h3></article>"
        "<article class='item-news'><div class='thumb-art'><img src='i'></div><h3 class='title-news'><a href='https://vnexpress.net/2' title='Attr'>x</a></h3><span class='time-count'><span> 2h </span></span></article></div>",
    "https://vietnamnet.vn/tin-tuc-24h":
        "<div class='container__left'></div><div class='container__left'>" + "".join(
            f"<div class='horizontalPost'><div class='horizontalPost__main'><h{h} class='horizontalPost__main-title'><a href='{u}'> V </a></h{h}></div></div>"
            for h, u in ((2, "a"), (3, "https://vietnamnet.vn/a"), (2, "b"))) + "<div class='horizontalPost'></div></div>",
    "https://www.vietnamplus.vn/topic":
        "<div class='timeline'><article class='story'><h2 class='story__heading'><i class='ic-video'></i><a class='cms-link' href='/v' title='V'></a></h2></article>"
        "<article class='story'><h2 class='story__heading'><a class='cms-link' href='/p' title=' P '></a></h2></article>"
        "<article class='story'><h2 class='story__heading'><a class='cms-link' href=''></a></h2></article><article class='story'></article></div>",
    "https://tuoitre.vn/tin-moi-nhat.htm":
        "<div id='load-list-news' class='list box-category-middle'><div class='box-category-item'><a class='box-category-link-with-avatar' href='/t'>x</a></div></div>",
    "https://dantri.com.vn/tin-moi-nhat.htm":
        "<div class='article-newest'><article class='article-newest-item'><div class='article-thumb'><a href='/d'><img src='i'></a></div><h3 class='article-title'><a> D </a></h3><div class='article-time'>5p</div></article>"
        "<article class='article-newest-item'><div class='article-thumb'><a href='/d'><img src='i'></a></div></article>"
        "<article class='article-newest-item'><a href='/noimg'>x</a></article><article class='article-newest-item'><a href='/e'><img src='i2'></a></article></div>",
}


def listed(spark, limit=20):
    frame = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(LISTS.items())], "page_id bigint, url string, html string")
    got = {}
    for r in pages.listing(frame, limit=limit).orderBy("site", "position").collect():
        got.setdefault(r.site, []).append((r.title, r.url, r.date_posted, r.image_url))
    return got


def test_list_pages(spark):
    got = listed(spark)
    assert got["nld"] == [("No title" if not i else f"N{i}", f"https://nld.com.vn/n{i}", "1h", f"i{i}") for i in range(4)]
    assert got["vnexpress"] == [("Attr", "https://vnexpress.net/2", "2h", "i")]
    assert [r[:3] for r in got["vietnamnet"]] == [("V", "https://vietnamnet.vn/a", None), ("V", "https://vietnamnet.vn/b", None)]
    assert got["vietnamplus"] == [("P", "https://www.vietnamplus.vn/p", "Unknown time", None)]
    assert got["tuoitre"] == [("No title", "https://tuoitre.vn/t", None, None)]
    assert got["dantri"] == [("D", "https://dantri.com.vn/d", "5p", "i"), ("No title", "https://dantri.com.vn/e", "Unknown", "i2")]


def test_limit_comes_before_or_after_the_filters(spark):
    got = listed(spark, limit=2)
    assert len(got["nld"]) == 2
    assert [r[1] for r in got["vietnamnet"]] == ["https://vietnamnet.vn/a"]  # the repeat used up a place
    assert [r[1] for r in got["dantri"]] == ["https://dantri.com.vn/d", "https://dantri.com.vn/e"]


@pytest.mark.parametrize("url,site", [("https://m.vnexpress.net/x", "vnexpress"), ("https://t.co/?u=nld.com.vn&tuoitre.vn", "nld"), ("https://x.test", None)])
def test_router_takes_the_first_rule(spark, url, site):
    frame = spark.createDataFrame([(url,)], "url string")
    assert frame.select(pages.route(F.col("url"), pages.SITES)).first()[0] == site
