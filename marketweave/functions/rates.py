"""Numbers and dates in the notations of the rate file."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketweave.functions import values as V


def number(text: Column) -> Column:
    """A number with either sign as decimal mark: of both the last is it; one alone is a thousands mark before exactly three last
    digits. Anything that is no number gives null."""
    s = F.regexp_replace(text, r"[^\d.,\-]", "")
    dot, comma = F.contains(s, F.lit(".")), F.contains(s, F.lit(","))
    last = lambda c: F.locate(c, F.reverse(s))  # noqa: E731  (from the end; smaller is later)
    plain = (
        F.when(dot & comma & (last(",") < last(".")), F.translate(s, ",.", "."))
        .when(dot & comma, F.translate(s, ",", ""))
        .when(comma & s.rlike(r",\d{3}$"), F.translate(s, ",", ""))
        .when(comma, F.translate(s, ",", "."))
        .when(dot & s.rlike(r"\.\d{3}$"), F.translate(s, ".", "")).otherwise(s)
    )
    return F.nullif(plain, F.lit("")).try_cast("double")


def rate_date(text: Column, day_first: bool = True) -> Column:
    """The day that a text names: year first, a day with a month name before or after it, or all numbers in the order given, else
    the other.

    Year-first dates may have a time, which is left out; years of two digits are 1969 to 2068. Month names are those of the rate
    file and English ones, in full or by three letters. Anything before or after, and a day that no calendar has, gives null.
    """
    s = F.btrim(text)
    months = F.create_map(*(F.lit(x) for kv in {**V.MONTHS, **V.RATE_MONTHS}.items() for x in kv))

    def named(pattern: str, day: int, month: int, year: int) -> Column:
        part = lambda i: F.regexp_extract(s, pattern, i)
        number = F.try_element_at(months, F.lower(part(month)))
        return F.when(number.isNotNull(), F.try_to_date(F.concat_ws("-", part(year), number.cast("string"), part(day)), "yyyy-M-d"))

    year_first = r"^(\d{4}([-/.])\d{1,2}\2\d{1,2})(?:[T ]\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?)?$"
    numbers = F.regexp_replace(s, r"[.\-]", "/")
    short = F.regexp_replace(numbers, r"/(\d{2})$", "/20$1")
    short = F.when(F.regexp_extract(numbers, r"/(\d{2})$", 1) >= "69", F.regexp_replace(numbers, r"/(\d{2})$", "/19$1")).otherwise(short)
    orders = ("d/M/yyyy", "M/d/yyyy") if day_first else ("M/d/yyyy", "d/M/yyyy")
    return (
        F.when(s.rlike(r"^\d{4}-"), F.try_to_date(F.regexp_extract(s, year_first, 1), "yyyy-M-d"))
        .when(s.rlike(year_first), F.try_to_date(F.regexp_replace(F.regexp_extract(s, year_first, 1), r"[/.]", "-"), "yyyy-M-d"))
        .when(s.rlike(r"^\d{1,2}[\s\-/]+[A-Za-z]+[\s\-/]+\d{4}$"), named(r"^(\d{1,2})[\s\-/]+([A-Za-z]+)[\s\-/]+(\d{4})$", 1, 2, 3))
        .when(s.rlike(r"^[A-Za-z]+\.?[\s\-/]+\d{1,2},?[\s\-/]+\d{4}$"), named(r"^([A-Za-z]+)\.?[\s\-/]+(\d{1,2}),?[\s\-/]+(\d{4})$", 2, 1, 3))
        .when(s.rlike(r"^\d{1,2}[/.\-]\d{1,2}[/.\-]\d{4}$"), F.coalesce(*(F.try_to_date(numbers, o) for o in orders)))
        .when(s.rlike(r"^\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2}$"), F.coalesce(*(F.try_to_date(short, o) for o in orders)))
    )


def direction(log_return: Column, flat: float = V.FLAT) -> Column:
    """up, down, or flat within the dead zone and where there is no return."""
    return F.when(log_return > flat, "up").when(log_return < -flat, "down").otherwise("flat")
