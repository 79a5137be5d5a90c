"""Column -> Column text, date and name functions (all built-in, no Python per row)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from ..settings import NOTE_FIELDS, Settings

# Characters a Python-style strip removes (Spark's own trim removes only the blank).
WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
              "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
              "\u2028\u2029\u202f\u205f\u3000")
SPACES = r"(?U)\s+"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def literal_regex(text: str) -> str:
    """Quote a plain text for use inside a Java regular expression."""
    return "".join(ch if ch.isalnum() or ch == " " else "\\" + ch for ch in text)


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def words(c: Column) -> Column:
    """Whitespace-separated tokens; an empty text gives an empty array."""
    return F.filter(F.split(strip(c), SPACES), lambda w: w != "")


# --- dates and times -----------------------------------------------------------------

def stay_date(c: Column) -> Column:
    """`M/D/YYYY`, trimmed; anything else is null."""
    t = strip(c)
    return F.when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), _try_date(t, "M/d/yyyy"))


def booking_date(c: Column) -> Column:
    """short month name first, then the full one."""
    t = F.regexp_replace(strip(c), SPACES, " ")
    return F.coalesce(_try_date(t, "MMM d, yyyy"), _try_date(t, "MMMM d, yyyy"))


def _try_date(c: Column, pattern: str) -> Column:
    return F.try_to_date(c, pattern)  # never raises, also under ANSI mode


def calendar_date(year: Column, month: Column, day: Column) -> Column:
    """Date from three integers, null when there is no such day.  Whole numbers only: no text is made and parsed again."""
    inside = year.between(1, 9999) & month.between(1, 12) & day.between(1, 31)
    date = F.date_add(F.make_date(year, F.least(F.greatest(month, F.lit(1)), F.lit(12)), F.lit(1)), day - 1)
    return F.when(inside & (F.month(date) == month), date)


def clock(c: Column) -> Column:
    """hour and minute of the first number as `hour * 100 + minute`; am/pm ignored."""
    pattern = r"(\d{1,2})(?::(\d{2}))?"
    hour = blank_to_null(F.regexp_extract(c, pattern, 1)).cast("int")
    minute = F.coalesce(blank_to_null(F.regexp_extract(c, pattern, 2)).cast("int"), F.lit(0))
    return hour * 100 + minute


def evening_clock(c: Column) -> Column:
    """`H:MM` is shown as `H:MM PM`, anything else unchanged."""
    t = strip(c)
    return F.when(t.rlike(r"^\d{1,2}:\d{2}$"), F.concat(t, F.lit(" PM"))).otherwise(c)


def nights(arrival: Column, departure: Column) -> Column:
    """nights as text, blank when unknown or negative."""
    n = F.datediff(departure, arrival)
    return F.when(n >= 0, n.cast("string")).otherwise("")


# --- venues, outside phrases, unit hints ---------------------------------------------

def venue_of(c: Column, settings: Settings) -> Column:
    """the first keyword in configuration order that occurs in the text."""
    low = F.lower(c)
    return F.coalesce(*[F.when(low.contains(k.lower()), F.lit(v)) for k, v in settings.venues],
                      F.lit(None).cast("string"))


def has_venue(c: Column, settings: Settings) -> Column:
    low = F.lower(c)
    return any_of([low.contains(k.lower()) for k, _ in settings.venues])


def is_outside(c: Column, settings: Settings) -> Column:
    """any outside phrase as a plain substring (or as whole words, if so set)."""
    low = F.lower(F.coalesce(c, F.lit("")))
    if settings.outside_whole_word:
        return any_of([low.rlike(rf"\b{literal_regex(p)}\b") for p in settings.outside_phrases])
    return any_of([low.contains(p) for p in settings.outside_phrases])


def unit_hint(c: Column, settings: Settings) -> Column:
    """what is left of the tags after venue words, outside phrases and shorthand."""
    edge = r"\b" if settings.outside_whole_word else ""
    text = c
    for keyword, _ in settings.venues:
        text = F.regexp_replace(text, "(?iu)" + literal_regex(keyword), "")
    for phrase in settings.outside_phrases:
        text = F.regexp_replace(text, "(?iu)" + edge + literal_regex(phrase) + edge, "")
    kept = F.filter(F.split(text, r"(?U)[\s,.\-]+"),
                    lambda t: (t != "") & ~F.lower(t).isin(*settings.shorthand))
    return blank_to_null(F.btrim(F.array_join(kept, " "), F.lit(" -,.")))


def clean_hint(c: Column) -> Column:
    """drop the possessive left in front of the hint."""
    return strip(F.regexp_replace(c, r"(?i)^'?s\b\s*", ""))


def hint_tokens(c: Column) -> Column:
    """letter runs in upper case as 3-, 2- and 1-grams, left to right."""
    w = F.transform(F.regexp_extract_all(c, F.lit("([A-Za-z]+)"), 1), lambda t: F.upper(t))

    def grams(n: int) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)),
                           lambda i: F.array_join(F.slice(w, i, n), ""))
        return F.when(F.size(w) >= n, runs).otherwise(F.array().cast("array<string>"))

    return F.concat(grams(3), grams(2), grams(1))


def shown_unit(is_outside_guest: Column, hint: Column, hinted_unit: Column) -> Column:
    """outside label, the unit the hint resolves to, or the cleaned hint."""
    rest = strip(F.regexp_replace(hint, r"(?i)^['\s,.\-]*s\b[\s,.\-]*", ""))
    return F.when(is_outside_guest, F.lit("Outside guest")).otherwise(F.coalesce(hinted_unit, rest, F.lit("")))


# --- names ---------------------------------------------------------------------------

def name_key(c: Column) -> Column:
    """Trimmed, lower-cased name: everything below depends on the name only through it."""
    return F.lower(strip(F.coalesce(c, F.lit(""))))


def _before_comma(k: Column) -> Column:
    return strip(F.substring_index(k, ",", 1))


def _after_comma(k: Column) -> Column:
    return strip(F.regexp_replace(k, "^[^,]*,", ""))


def is_bare(k: Column) -> Column:
    """one token and no comma."""
    return ~k.contains(",") & (F.size(words(k)) == 1)


def surname(k: Column) -> Column:
    """text before the comma, else the last token; null when there is none."""
    return blank_to_null(F.when(k.contains(","), _before_comma(k))
                         .otherwise(F.try_element_at(words(k), F.lit(-1))))


def first_name(k: Column) -> Column:
    """first token of the first-name part without dots; null for a bare name."""
    after = F.try_element_at(words(_after_comma(k)), F.lit(1))
    plain = F.when(F.size(words(k)) >= 2, F.try_element_at(words(k), F.lit(1)))
    return F.regexp_replace(F.when(k.contains(","), after).otherwise(plain), r"\.", "")


def group_surname(k: Column) -> Column:
    """like F20, but an empty surname stays an empty text."""
    return F.when(k.contains(","), _before_comma(k)).otherwise(
        F.coalesce(F.try_element_at(words(k), F.lit(-1)), k))


def name_variants(k: Column) -> Column:
    """the name as given and reordered ("last, first" <-> "first last")."""
    w = words(k)
    swapped = F.when(k.contains(","), F.concat(_after_comma(k), F.lit(" "), _before_comma(k)))
    swapped = swapped.when(F.size(w) >= 2, F.concat(
        F.try_element_at(w, F.lit(-1)), F.lit(", "),
        F.array_join(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), " ")))
    both = F.transform(F.array_compact(F.array(k, swapped)), lambda v: strip(v))
    return F.filter(both, lambda v: v != "")


def sort_tokens(c: Column) -> Column:
    """Whitespace tokens in sorted order, joined by one blank."""
    return F.array_join(F.array_sort(words(c)), " ")


# --- note keywords -------------------------------------------------------------------

def all_notes(prefix: str = "") -> Column:
    """the three note fields joined by a blank."""
    return F.concat_ws(" ", *[F.coalesce(F.col(prefix + f), F.lit("")) for f in NOTE_FIELDS])


# Fixed patterns of the keyword detectors
CONSORTIUM = r"(?i)virtuoso"
BREAKFAST = r"(?i)breakfast\s+incl\w*"
PET = r"(?i)pet\s+(amenit\w*|friendly)"
EXTRA_BED = (r"(?i)sofa[\s-]?bed|pull[\s-]?out|sleeper\s+sofa|sofa\s+sleeper|roll[\s-]?away"
             r"|(extra|additional)\s+bed|fold[\s-]?out|(?U)\bcots?\b")


def has_consortium_perk(text: Column) -> Column:
    return text.rlike(CONSORTIUM)


def has_breakfast(text: Column) -> Column:
    return text.rlike(BREAKFAST)


def has_pet(text: Column) -> Column:
    return text.rlike(PET)


# Every alternative of EXTRA_BED has one of these words, which are looked for first.
EXTRA_BED_WORDS = ("sofa", "pull", "roll", "bed", "fold", "cot")


def requests_extra_bed(text: Column) -> Column:
    low = F.lower(text)
    return any_of([low.contains(w) for w in EXTRA_BED_WORDS]) & text.rlike(EXTRA_BED)


# --- severity ------------------------------------------------------------------------

# mismatch > needs a look > nothing to compare > clean
RED, YELLOW, BLUE, GREEN = 3, 2, 1, 0
SEVERITY_NAMES = {RED: "RED", YELLOW: "YELLOW", BLUE: "BLUE", GREEN: "GREEN"}

