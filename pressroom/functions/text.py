"""Text rules as Column expressions.

Character classes are spelled out because the short forms differ between regex engines:
``WORD`` is what a Unicode-aware ``\\w`` accepts and ``SPACE`` what ``str.isspace`` accepts.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

WORD = r"\p{L}\p{N}_"
SPACE = (
    r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)

# The characters of ``SPACE``, for one-pass replacement: patterns over plain blanks are far cheaper
# than patterns over the class.
SPACE_CHARACTERS = "".join(
    chr(code)
    for first, last in (
        (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
        (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
    )
    for code in range(first, last + 1)
)

# ASCII punctuation, the stopword list of the topic classifier, the toxic keyword
# list of comment moderation, and the letters the sentiment rule keeps.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

STOPWORDS = tuple(
    """
    và nhưng có không cũng rất vì đã đang được trên dưới cho từ là với như của ở để thì bị bởi này
    nọ nào tại ra đó vậy gì khi lúc nên mà vẫn đâu đây điều sao đôi tuy mỗi một các nhiều hơn đều
    cần trước sau nữa phải hoặc ai thế nhỉ vừa mới phía trong ngoài khác nếu làm hết qua dù rằng
    suốt thành đến chỉ thể thật biết bằng cái bao rồi luôn chưa cùng theo nơi đi dùng do lại hay
    mình bạn com net org http https www tin bài về người những
    """.split()
)

TOXIC_KEYWORDS = (
    "đm", "dm", "đmm", "dmm", "vãi", "shit", "fuck",
    "con chó", "thằng lol", "mẹ kiếp", "đồ ngu", "óc chó",
    "nam kỳ", "bắc kỳ", "nam kì", "bắc kì", "rác",
)

SENTIMENT_LETTERS = (
    "a-zàáạảãâầấậẩẫăằắặẳẵèéẹẻẽêềếệểễìíịỉĩòóọỏõôồốộổỗơờớợởỡùúụủũưừứựửữỳýỵỷỹđ"
)

EMOJI = (
    r"\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}"
    r"\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}\x{24C2}-\x{1F251}"
)


def strip(col: Column) -> Column:
    """Trim every kind of white space, not blanks only."""
    return F.regexp_replace(col, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def blanks(col: Column) -> Column:
    """Every white-space character as a plain blank."""
    return F.translate(col, SPACE_CHARACTERS, " " * len(SPACE_CHARACTERS))


def squash(col: Column) -> Column:
    """Trim and turn each run of white space into one blank."""
    return _squash_blanks(blanks(col))


def _squash_blanks(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, "  +", " "))


def _chain(col: Column, *steps: tuple[str, str]) -> Column:
    return reduce(lambda acc, step: F.regexp_replace(acc, step[0], step[1]), steps, col)


def clean_comment(col: Column) -> Column:
    """Export cleaning: drop tags and everything but words and spaces, lower, trim; NULL → ''."""
    bare = _chain(F.coalesce(col, F.lit("")), (r"<[^\n]*?>", ""), (f"[^{WORD}{SPACE}]", ""))
    return strip(F.lower(bare))


def moderation_text(col: Column) -> Column:
    """Moderation cleaning: URLs, e-mails and phone numbers out, basic punctuation kept.

    The e-mail and number patterns look for the rare first character before they look around,
    and never try a run of text twice, so a long run costs linear time.
    """
    bare = _chain(
        blanks(F.coalesce(col, F.lit(""))),
        ("https?://[^ ]+", " "),
        (r"www\.[^ ]+", " "),
        ("(?<![^ ])[^ ][^ @]*+@[^ ]+", " "),
        (rf"(?=\p{{Nd}})(?<![{WORD}])\p{{Nd}}{{10,11}}(?![{WORD}])", " "),
        (f"[^{WORD} .,!?]+", " "),
    )
    return _squash_blanks(bare)


def sentiment_text(col: Column) -> Column:
    """Sentiment cleaning: URLs and emoji out, lower, collapse repeats, Vietnamese letters only.

    Line breaks become blanks at once: they would survive the collapse but not the last step.
    """
    lowered = F.lower(
        _chain(
            blanks(F.coalesce(col, F.lit(""))),
            ("http[^ ]+|www[^ ]+", " "),
            (f"(?![a-z ])[{EMOJI}]+", " "),
        )
    )
    # The look-ahead passes plain letters before the long letter class is tried.
    kept = _chain(lowered, (r"(.)\1+", "$1"), (f"(?![a-z ])[^{SENTIMENT_LETTERS} ]+", " "))
    return _squash_blanks(kept)


_MARK = "[" + "".join("\\" + mark for mark in PUNCTUATION) + "]"
# A run of marks at the end or at the start of a word; each run is tried once.
_OUTER_MARKS = f"(?={_MARK})(?:(?<!{_MARK}){_MARK}++(?![^ ])|(?<![^ ]){_MARK}+)"


def training_words(col: Column) -> Column:
    """Split on white space, strip ASCII punctuation, lower: the classifier's training words.

    The text is treated as a whole before it is split, which is cheaper than word by word. A blank
    text has no words; a word of marks only is an empty word.
    """
    lowered = F.lower(squash(F.coalesce(col, F.lit(""))))
    words = F.split(F.regexp_replace(lowered, _OUTER_MARKS, ""), " ")
    return F.when(lowered == "", F.array().cast("array<string>")).otherwise(words)


def is_vocabulary_word(word: Column, stopwords: Sequence[str] = STOPWORDS) -> Column:
    """Length and stopword filter that decides which words may enter a vocabulary."""
    return (F.length(word) > 2) & ~word.isin(list(stopwords))


def serving_words(col: Column) -> Column:
    """Lower-cased runs of at least two word characters: the classifier's serving words."""
    lowered = F.lower(F.coalesce(col, F.lit("")))
    return F.regexp_extract_all(lowered, F.lit(f"[{WORD}]{{2,}}"), F.lit(0))


def has_keyword(clean: Column, keywords: Sequence[str] = TOXIC_KEYWORDS) -> Column:
    """Substring test against cleaned text, case-insensitive; a keyword inside a word counts."""
    lowered = F.lower(clean)
    return reduce(or_, (F.contains(lowered, F.lit(word)) for word in keywords))


def snippet(col: Column, size: int = 50) -> Column:
    """First ``size`` characters, always followed by dots."""
    return F.concat(F.substring(col, 1, size), F.lit("..."))


def snippet_if_longer(col: Column, size: int = 100) -> Column:
    """Dots only when something was cut."""
    return F.when(F.length(col) > size, snippet(col, size)).otherwise(col)


def title_case(col: Column) -> Column:
    """Upper-case the first letter of each run of letters, as Python's ``str.title`` does."""
    runs = F.regexp_extract_all(col, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    cased = F.transform(
        runs,
        lambda run: F.concat(
            F.upper(F.substring(run, 1, 1)), F.lower(F.substring(run, F.lit(2), F.length(run)))
        ),
    )
    return F.array_join(cased, "")
