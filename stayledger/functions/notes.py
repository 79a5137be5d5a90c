"""Note grammar: entries, dates, times and weekdays of a free-text note."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..settings import MONTHS, WEEKDAYS, Settings
from .text import any_of, blank_to_null, calendar_date, has_venue, strip

# Fixed note patterns.  Where one begins with a digit, that is looked at before the word boundary, which costs more.
TIME = r"(?U)(?=\d)\b(\d{1,2})(?::(\d{2}))?\s*([AaPp][Mm])\b"
NUMERIC = r"(?U)(?=\d)\b(\d{1,2})/(\d{1,2})(?:\s*&\s*(?:\d{1,2}/)?(\d{1,2}))?\b"
WEEKDAY = r"(?iU)\b(" + "|".join(WEEKDAYS) + r")\b"
SPELLED = r"(?iU)\b(" + "|".join(MONTHS) + r")\s+(\d{1,2})(?:st|nd|rd|th)?\b"

# A text without any of these, whatever its case, names no weekday and no month: they are looked for before the pattern.  They have no
# letter (i, k, s) that also stands for one outside ASCII.
WEEKDAY_PARTS, MONTH_PARTS = ("day",), ("uary", "march", "apr", "may", "ju", "augu", "ber")


def note_entries(text: Column, settings: Settings) -> Column:
    """blank lines separate parts; inside a part a comma starts a new entry only
    where the next piece names a venue and something has been read already."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def read(state: Column, piece: Column) -> Column:
        close = has_venue(piece, settings) & (state["open"] != "")
        return F.struct(
            F.when(close, F.concat(state["done"], F.array(strip(state["open"]))))
            .otherwise(state["done"]).alias("done"),
            F.when(close | (state["open"] == ""), piece)
            .otherwise(F.concat(state["open"], F.lit(","), piece)).alias("open"))

    def finish(state: Column) -> Column:
        last = strip(state["open"])
        return F.when(last != "", F.concat(state["done"], F.array(last))).otherwise(state["done"])

    def whole(part: Column) -> Column:
        """No comma can start an entry: none is there, or no venue comes after the first one."""
        rest = part.substr(F.instr(part, ",") + 1, F.length(part))
        return ~part.contains(",") | (~part.startswith(",") & ~has_venue(rest, settings))

    def single(part: Column) -> Column:
        return F.when(strip(part) != "", F.array(strip(part))).otherwise(F.array().cast("array<string>"))

    def part_entries(part: Column) -> Column:
        pieces = F.split(part, r"(?U),(?=\s*[A-Za-z0-9/])", -1)
        return F.when(whole(part), single(part)).otherwise(F.aggregate(pieces, start, read, finish))

    entries = F.flatten(F.transform(F.split(text, r"\n\n+", -1), part_entries))
    return F.when(has_venue(text, settings), F.when(~text.contains("\n\n") & whole(text), single(text)).otherwise(entries))


def mention_bound(text: Column, settings: Settings) -> Column:
    """Upper bound of the mentions in a text: every entry with a venue has one of its words
    for itself, and two days at most."""
    low = F.lower(text)
    words = [(F.length(low) - F.length(F.replace(low, F.lit(k.lower()), F.lit("")))) / len(k.lower()) for k, _ in settings.venues]
    return (2 * F.coalesce(sum(words, F.lit(0)), F.lit(0))).cast("int")


def _has_part(c: Column, parts: tuple[str, ...]) -> Column:
    low = F.lower(c)
    return any_of([low.contains(p) for p in parts])


def time_token(c: Column) -> Column:
    """a time is only a time with am/pm."""
    return F.regexp_substr(c, F.lit(TIME))


def weekday_token(c: Column) -> Column:
    """F31"""
    return F.when(_has_part(c, WEEKDAY_PARTS), F.upper(blank_to_null(F.regexp_extract(c, WEEKDAY, 1))))


def weekday_index(token: Column) -> Column:
    return F.nullif(F.array_position(F.array(*[F.lit(w) for w in WEEKDAYS]), token), F.lit(0)) - 1


def numeric_date(c: Column) -> tuple[Column, Column, Column]:
    """F32: month, day and the optional second day.  The text is searched once; the groups are those of what was found."""
    found = F.when(c.contains("/"), F.regexp_extract(c, NUMERIC, 0))
    return tuple(blank_to_null(F.regexp_extract(found, NUMERIC, g)).cast("int") for g in (1, 2, 3))


def spelled_date(c: Column) -> tuple[Column, Column]:
    """Month number and day of `Month D`; the text is searched once."""
    found = F.when(_has_part(c, MONTH_PARTS), F.regexp_extract(c, SPELLED, 0))
    name = F.lower(F.regexp_extract(found, SPELLED, 1))
    month = F.nullif(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), name), F.lit(0))
    return month.cast("int"), blank_to_null(F.regexp_extract(found, SPELLED, 2)).cast("int")


def date_near_stay(month: Column, day: Column, arrival: Column, departure: Column) -> Column:
    """arrival's year, then departure's, if that falls inside the stay (both ends
    included); else arrival's year; null only for impossible days."""
    first = calendar_date(F.year(arrival), month, day)
    second = calendar_date(F.year(departure), month, day)
    return F.coalesce(F.when(first.between(arrival, departure), first),
                      F.when(second.between(arrival, departure), second), first)


def first_weekday(index: Column, arrival: Column) -> Column:
    """First day on or after arrival that falls on the weekday."""
    return F.date_add(arrival, F.pmod(index.cast("int") - F.weekday(arrival), F.lit(7)).cast("int"))


def weekday_count(index: Column, arrival: Column, departure: Column) -> Column:
    """how often the weekday occurs in [arrival, departure)."""
    left = F.datediff(departure, first_weekday(index, arrival))
    return F.when(left > 0, F.floor((left - 1) / 7).cast("int") + 1).otherwise(0)


def weekday_dates(index: Column, arrival: Column, departure: Column) -> Column:
    first = first_weekday(index, arrival)
    return F.when(weekday_count(index, arrival, departure) > 0,
                  F.sequence(first, F.date_sub(departure, 1), F.expr("interval 7 days")))
