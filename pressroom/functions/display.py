"""Display columns of the catalogue pages and the column limits of the article table."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from pressroom.functions.text import squash, strip, title_case

# Category names, placeholder texts and column limits.
CATEGORY_NAMES = {
    "nhip-song-tre": "Nhịp sống trẻ",
    "thoi-su": "Thời sự",
    "xe": "Xe",
    "kinh-doanh": "Kinh doanh",
    "giai-tri": "Giải trí",
    "the-thao": "Thể thao",
    "chinh-tri": "Chính trị",
    "phap-luat": "Pháp luật",
    "suc-khoe": "Sức khỏe",
    "van-hoa": "Văn hóa",
    "cong-nghe": "Công nghệ",
    "du-lich": "Du lịch",
    "am-nhac": "Âm nhạc",
    "giao-duc": "Giáo dục",
    "the-gioi": "Thế giới",
    "kinh-te-ky-thuat": "Kinh tế & Kỹ thuật",
}

ANONYMOUS = "Người dùng"
DEFAULT_THUMBNAIL = "/static/images/default-thumbnail.jpg"
NO_TITLE = "No title"
NO_DESCRIPTION = "No description"
UNKNOWN_AUTHOR = "Unknown author"

COLUMN_LIMITS = {
    "author": 255,
    "title": 500,
    "description": 1000,
    "content": 8000,
    "source_url": 1000,
    "image_urls": 2000,
    "video_urls": 2000,
}
OTHER_LIMIT = 8000


def category_name(slug: Column) -> Column:
    names = F.create_map(*[F.lit(part) for part in chain.from_iterable(CATEGORY_NAMES.items())])
    lowered = F.lower(slug)
    return F.coalesce(F.try_element_at(names, lowered), title_case(F.replace(lowered, F.lit("-"), F.lit(" "))))


def first_image(urls: Column, default: str = "") -> Column:
    """Text before the first comma; ``default`` for NULL and empty lists."""
    return F.when(F.coalesce(F.length(urls), F.lit(0)) == 0, F.lit(default)).otherwise(
        strip(F.split_part(urls, F.lit(","), F.lit(1)))
    )


def display_name(user_id: Column, first_name: Column, last_name: Column) -> Column:
    """``first last`` of a found user (``user_id`` not NULL), else the anonymous name."""
    return F.when(user_id.isNotNull(), F.concat(first_name, F.lit(" "), last_name)).otherwise(
        F.lit(ANONYMOUS)
    )


def author_line(col: Column, limit: int = 255) -> Column:
    return F.substring(squash(col), 1, limit)


def or_default(col: Column, default: str) -> Column:
    return F.coalesce(col, F.lit(default))


def truncated(name: str, col: Column) -> Column:
    return F.substring(col, 1, COLUMN_LIMITS.get(name, OTHER_LIMIT))


def list_text(urls: Column) -> Column:
    """Array of URLs → comma-joined text; NULL and empty → ''."""
    return F.coalesce(F.array_join(urls, ","), F.lit(""))
