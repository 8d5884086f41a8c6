"""Dates in the notations that postings use, as column expressions; nothing depends on today's date."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmark.functions.text import col

#: Tried in this order; the first that fits wins.
FORMATS = ("yyyy-MM-dd", "yyyy/M/d", "yyyy.M.d", "d MMMM yyyy", "d MMM yyyy", "MMMM d, yyyy", "MMM d, yyyy", "d/M/yyyy")


def parse(c, formats: tuple[str, ...] = FORMATS) -> Column:
    """The date of a short text: its time of day, ordinal endings and doubled blanks are ignored."""
    t = F.trim(F.regexp_replace(col(c), r"T?\s*\d{1,2}:\d{2}(:\d{2})?(\.\d+)?\s*(Z|[AaPp][Mm]|[A-Z]{3,4})?$", ""))
    t = F.regexp_replace(F.regexp_replace(t, r"(\d)(st|nd|rd|th)\b", "$1"), r"\s+", " ")
    return F.coalesce(*(F.try_to_timestamp(t, F.lit(f)).cast("date") for f in formats), iso(col(c)))


def iso(c) -> Column:
    """The first ISO date within the text."""
    found = F.regexp_extract(col(c), r"(\d{4}-\d{2}-\d{2})", 1)
    return F.try_to_timestamp(F.when(found != "", found), F.lit("yyyy-MM-dd")).cast("date")


def without_year(c, as_of: Column, most_past: int = 180) -> Column:
    """Of "3 March": that day in the year of ``as_of``, or in the next if it is long past."""
    year = F.year(as_of).cast("string")
    d = F.coalesce(*(F.try_to_timestamp(F.concat_ws(" ", col(c), year), F.lit(f)).cast("date") for f in ("d MMMM yyyy", "d MMM yyyy", "MMMM d yyyy", "MMM d yyyy")))
    return F.when(F.datediff(as_of, d) > most_past, F.add_months(d, 12)).otherwise(d)


def korean(c) -> Column:
    """The last date of a text such as "2026.3.1 ~ 26년 4월 15일": years of two digits are from 1970 on."""
    found = F.regexp_extract_all(col(c), F.lit(r"((?:\d{4}|\d{2})\s*[.년/-]\s*\d{1,2}\s*[.월/-]\s*\d{1,2})"))
    last = F.split(F.regexp_replace(F.try_element_at(found, F.lit(-1)), r"\s", ""), r"[^0-9]+")
    y = F.get(last, F.lit(0)).cast("int")
    year = F.when(y >= 100, y).when(y < 70, y + 2000).otherwise(y + 1900)
    return F.try_to_timestamp(F.concat_ws("-", year, F.get(last, F.lit(1)), F.get(last, F.lit(2))), F.lit("yyyy-M-d")).cast("date")


def relative(c, as_of: Column) -> Column:
    """Of "3 weeks ago", "yesterday", "30+ days ago": the day before ``as_of``; months of 30 and years of 365 days."""
    t = F.lower(col(c))
    n = F.regexp_extract(t, r"(\d+)", 1)
    n = F.when(n == "", 1).otherwise(n.cast("int"))
    unit = F.when(t.rlike("week"), 7).when(t.rlike("month"), 30).when(t.rlike("year"), 365).when(t.rlike("day"), 1).otherwise(0)
    ago = F.when(t.rlike("yesterday"), 1).when(t.rlike("today|just now|hour|minute"), 0).otherwise(n * unit)
    return F.when(t.rlike(r"ago|yesterday|today|just now"), F.date_sub(as_of, ago))


def told(day: Column) -> Column:
    """A date as text; one before year 1 as "0044-03-15 (BC)", as the oracle's engine writes it, not with a signed year."""
    early = F.concat(F.lpad((1 - F.year(day)).cast("string"), 4, "0"), F.date_format(day, "-MM-dd"), F.lit(" (BC)"))
    return F.when(F.year(day) > 0, day.cast("string")).otherwise(early)


def urgency_colour(days: Column) -> Column:
    """RRGGBB by the days left: a blend of two colours over 90 days, one of its own once they are over, null without
    a date."""
    # Shares of red, green and blue when due and from 90 days on; the colour of expired dates.
    due, later, expired = (0.80, 0.00, 0.00), (0.84, 0.96, 0.89), "AAAAAA"
    x = F.least(F.lit(90), days) / F.lit(90.0)
    part = lambda a, b: F.lpad(F.hex(F.floor((F.lit(a) * (1 - x) + F.lit(b) * x) * 255)), 2, "0")
    return F.when(days < 0, expired).when(days.isNotNull(), F.concat(*(part(a, b) for a, b in zip(due, later))))
