"""Publication-date normalisers and display formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from pressroom.functions.text import strip

STORED_FORMAT = "yyyy-MM-dd HH:mm:ss"

# The weekday pattern of the strict normaliser (it has no ``ư``, so ``Thứ tư``
# is left in place), the display formats, and the free-form patterns understood, day first.
# An ISO date is read day-before-month when that is possible, as day-first parsers do.
COMPAT_WEEKDAY = "Thứ [a-zA-Zàáảãạăắằẳẵặâầấẩẫậ]+, "
ANY_WEEKDAY = r"^(Thứ \p{L}+|Chủ nhật),? *"

DISPLAY_FORMATS = {
    "minute": "dd/MM/yyyy HH:mm",
    "day": "dd/MM/yyyy",
    "long": "dd MMMM, yyyy",
}

FREE_FORM_PATTERNS = (
    "d/M/yyyy H:m:s", "d/M/yyyy H:m", "d/M/yyyy, H:m", "d/M/yyyy - H:m", "d/M/yyyy",
    "M/d/yyyy H:m:s", "M/d/yyyy H:m", "M/d/yyyy",
    "d-M-yyyy H:m:s", "d-M-yyyy H:m", "d-M-yyyy, H:m", "d-M-yyyy - H:m", "d-M-yyyy",
    "d.M.yyyy H:m", "d.M.yyyy",
    "yyyy-d-M H:m:s", "yyyy-M-d H:m:s", "yyyy-d-M H:m", "yyyy-M-d H:m", "yyyy-d-M", "yyyy-M-d",
    "yyyy-d-M'T'H:m:s", "yyyy-M-d'T'H:m:s",
    "H:m d/M/yyyy", "H:m, d/M/yyyy", "H:m d-M-yyyy",
    "d MMM yyyy H:m", "d MMM yyyy", "d MMMM yyyy H:m", "d MMMM yyyy",
)


def _as_text(parsed: Column, default_ts: Column) -> Column:
    return F.date_format(F.coalesce(parsed, default_ts), STORED_FORMAT)


def normalise_strict(col: Column, default_ts: Column, compat: bool = False) -> Column:
    """``Thứ hai, 19/3/2025, 19:54 (GMT+7)`` → stored text, else the default.

    ``compat`` keeps the narrow weekday pattern.
    """
    trimmed = strip(col)
    dated = F.regexp_replace(trimmed, COMPAT_WEEKDAY if compat else ANY_WEEKDAY, "")
    dated = strip(F.replace(dated, F.lit(" (GMT+7)"), F.lit("")))
    return _as_text(F.try_to_timestamp(dated, F.lit("d/M/yyyy, H:m")), default_ts)


def normalise_free(
    col: Column, default_ts: Column, patterns: Sequence[str] = FREE_FORM_PATTERNS
) -> Column:
    """Day-first free text with `` GMT+7`` → stored text, else the default."""
    dated = strip(F.replace(col, F.lit(" GMT+7"), F.lit("")))
    tries = [F.try_to_timestamp(dated, F.lit(pattern)) for pattern in patterns]
    return _as_text(F.coalesce(*tries), default_ts)


def stored_text(col: Column) -> Column:
    return F.date_format(col, STORED_FORMAT)


def display_date(col: Column, style: str) -> Column:
    return F.date_format(col, DISPLAY_FORMATS[style])


def epoch_seconds(col: Column) -> Column:
    return F.unix_timestamp(col)
