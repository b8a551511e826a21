"""Text and date rules: golden rows, and Python models checked on generated text."""

import re
import string

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from pressroom.functions import dates, display, text

ALPHABET = "ab@.w1 9\t\n é_đ<>/!?-'ự,:hftps　😀"
SAMPLES = [
    "Đẹp quá!! số_1 … 12", "é", "<b>Hi</b> there", None, "", "    ", "mail a@b.c now", "@a @", "a@@b x@ @y",
    "call 0912345678 or 09123456789, not 123456789012 or x0912345678", "see http://x.y/z?q=1 and www.q.r!",
    "ngonnn quáááá", "a\n\nb", "Tin tức a 24h, cơ_quan x-y", "aaa  bb\t\tcc", "漢字 ok", "😀😀 vui", "0912345678 0912345678",
]


def values(spark, column, rows):
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s string")
    return [r[0] for r in frame.orderBy("i").select(column(F.col("s"))).collect()]


# The patterns of the text rules, in Python's own syntax.


def clean_model(s):
    return re.sub(r"[^\w\s]", "", re.sub(r"<.*?>", "", s or "")).lower().strip()


def moderation_model(s):
    for pattern in (r"http[s]?://\S+", r"www\.\S+", r"\S+@\S+", r"\b\d{10,11}\b", r"[^\w\s\.,!?]"):
        s = re.sub(pattern, " ", s or "")
    return " ".join(s.split())


def sentiment_model(s):
    s = re.sub(r"http\S+|www\S+", " ", s or "")
    s = re.sub("[\U0001f600-\U0001f64f\U0001f300-\U0001f5ff\U0001f680-\U0001f6ff\U0001f1e0-\U0001f1ff"
               "✂-➰Ⓜ-\U0001f251]+", " ", s).lower()
    s = re.sub(r"(.)\1+", r"\1", s)
    return " ".join(re.sub(f"[^{text.SENTIMENT_LETTERS}\\s]", " ", s).split())


def training_model(s):
    return [w.strip(string.punctuation).lower() for w in (s or "").split()]


def serving_model(s):
    return re.findall(r"\b\w\w+\b", (s or "").lower())


MODELS = [
    (text.clean_comment, clean_model),
    (text.moderation_text, moderation_model),
    (text.sentiment_text, sentiment_model),
    (text.training_words, training_model),
    (text.serving_words, serving_model),
    (text.title_case, lambda s: None if s is None else s.title()),
    (text.strip, lambda s: None if s is None else s.strip()),
]
SAFE = [s for s in SAMPLES if s is None or "́" not in s]


@pytest.mark.parametrize("column,model", MODELS)
def test_samples_match_python(spark, column, model):
    assert values(spark, column, SAFE) == [model(s) for s in SAFE]


@pytest.mark.parametrize("column,model", MODELS)
@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.text(ALPHABET, max_size=60), min_size=150, max_size=200))
def test_generated_text_matches_python(spark, column, model, rows):
    got, want = values(spark, column, rows), [model(s) for s in rows]
    assert [(r, g, w) for r, g, w in zip(rows, got, want) if g != w] == []


def test_golden_rows(spark):
    assert values(spark, text.clean_comment, ["Đẹp quá!! số_1 … 12", "é"]) == ["đẹp quá số_1  12", "e"]
    assert values(spark, text.sentiment_text, ["ngonnn quáááá"]) == ["ngon quá"]
    assert values(spark, text.serving_words, ["Tin tức a 24h, cơ_quan x-y"]) == [["tin", "tức", "24h", "cơ_quan"]]
    assert values(spark, text.title_case, ["kinh te-o'neil 3d"]) == ["Kinh Te-O'Neil 3D"]


def test_long_run_is_linear(spark):
    assert values(spark, text.moderation_text, ["x" * 400_000]) == ["x" * 400_000]


def test_keywords_match_inside_words(spark):
    assert values(spark, text.has_keyword, ["gọi admin", "tốt", "Đồ NGU", "con  chó", "con chó"]) == [
        True, False, True, False, True,
    ]


def test_vocabulary_filter(spark):
    rows = ["và", "ab", "abc", "những", "thể"]
    assert values(spark, text.is_vocabulary_word, rows) == [False, False, True, False, False]


def default_ts():
    return F.lit("2024-01-01 00:00:00").cast("timestamp")


def test_strict_dates(spark):
    rows = ["Thứ tư, 19/3/2025, 19:54 (GMT+7)", "Thứ sáu, 19/3/2025, 19:54 (GMT+7)", "19/3/2025, 9:5", "Chủ nhật, 2/3/2025, 01:00 (GMT+7)",
            "19/3/2025", "", None, "31/2/2025, 10:00"]
    default = "2024-01-01 00:00:00"
    fixed = ["2025-03-19 19:54:00", "2025-03-19 19:54:00", "2025-03-19 09:05:00", "2025-03-02 01:00:00"] + [default] * 4
    assert values(spark, lambda c: dates.normalise_strict(c, default_ts()), rows) == fixed
    compat = [default, fixed[1], fixed[2]] + [default] * 5
    assert values(spark, lambda c: dates.normalise_strict(c, default_ts(), compat=True), rows) == compat


def test_free_dates_are_day_first(spark):
    rows = ["4/3/2025 07:08 GMT+7", "19-03-2025 19:54 GMT+7", "3/19/2025 10:00", "2025-03-04", "2025-03-14", "04/03/2025", "hôm nay", None]
    assert values(spark, lambda c: dates.normalise_free(c, default_ts()), rows) == [
        "2025-03-04 07:08:00", "2025-03-19 19:54:00", "2025-03-19 10:00:00", "2025-04-03 00:00:00",
        "2025-03-14 00:00:00", "2025-03-04 00:00:00", "2024-01-01 00:00:00", "2024-01-01 00:00:00",
    ]


def test_display_columns(spark):
    assert values(spark, display.category_name, ["Xe", "kinh-te-ky-thuat", "la-lung-3d", None]) == ["Xe", "Kinh tế & Kỹ thuật", "La Lung 3D", None]
    assert values(spark, display.first_image, [" a.jpg , b.jpg", "", None]) == ["a.jpg", "", ""]
    assert values(spark, lambda c: display.first_image(c, display.DEFAULT_THUMBNAIL), [None]) == [display.DEFAULT_THUMBNAIL]
    assert values(spark, lambda c: text.snippet_if_longer(c, 3), ["abc", "abcd"]) == ["abc", "abc..."]
    assert values(spark, lambda c: text.snippet(c, 3), ["ab"]) == ["ab..."]
