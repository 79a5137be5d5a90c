"""Venue mentions in the notes of a stay, one row per resolved day."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import notes as N
from ..functions import text as T
from ..settings import NOTE_FIELDS, Settings


def note_entries(stays: DataFrame, settings: Settings) -> DataFrame:
    """(stay_seq, field_ord, source_field, entry_ord, entry) for entries with a venue."""
    texts = F.array(*[F.struct(F.lit(i).alias("field_ord"), F.lit(f).alias("source_field"),
                               F.col(f).alias("text")) for i, f in enumerate(NOTE_FIELDS)])
    keep = [c for c in ("stay_seq", "name_key", "arrival", "departure") if c in stays.columns]
    return (stays.where(T.any_of([T.has_venue(F.col(f), settings) for f in NOTE_FIELDS]))
            .select(*keep, F.explode(texts).alias("note"))
            .where(T.has_venue(F.col("note.text"), settings))
            .select(*keep, "note.field_ord", "note.source_field", N.note_entries(F.col("note.text"), settings).alias("entries"))
            # Of a bare column Spark would ask, before it is exploded, whether it is empty, and work it out once more for that.
            .select(*keep, "field_ord", "source_field", F.posexplode(F.coalesce("entries", F.array().cast("array<string>"))).alias("entry_ord", "entry"))
            .where(T.has_venue(F.col("entry"), settings)))


def note_mentions(stays: DataFrame, settings: Settings) -> DataFrame:
    """Mentions in note order; `date_ord` tells the days of an "A & B" entry apart.

    A pure projection of the stays: nothing is shuffled.  The days an ambiguous weekday may
    mean are not spelled out, as a stay may be of any length; see `notes.weekday_dates`.
    """
    e = F.col("entry")
    month, day, day2 = N.numeric_date(e)
    s_month, s_day = N.spelled_date(e)
    df = note_entries(stays, settings).withColumns({
        "venue": T.venue_of(e, settings), "time_text": N.time_token(e),
        "weekday_text": N.weekday_token(e), "m": month, "d": day, "d2": day2,
        "sm": s_month, "sd": s_day})
    df = df.withColumns({
        "weekday": N.weekday_index(F.col("weekday_text")).cast("int"),
        "style": F.when(F.col("arrival").isNull() | F.col("departure").isNull(), "no_stay_dates")
        .when(F.col("m").isNotNull(), "numeric").when(F.col("sm").isNotNull(), "spelled")
        .when(F.col("weekday_text").isNotNull(), "weekday").otherwise("none")})
    arrival, departure = F.col("arrival"), F.col("departure")
    named = (F.col("style") == "numeric") | (F.col("style") == "spelled")
    df = df.withColumns({
        "first_day": F.when(named, N.date_near_stay(
            F.coalesce("m", "sm"), F.when(F.col("style") == "numeric", F.col("d")).otherwise(F.col("sd")),
            arrival, departure)),
        "times_in_stay": F.when(F.col("style") == "weekday",
                                N.weekday_count(F.col("weekday"), arrival, departure)).otherwise(0)})
    first = F.col("first_day")
    second = F.when(F.col("style") == "numeric",
                    N.calendar_date(F.year(first), F.month(first), F.col("d2")))
    weekday_day = F.when(F.col("times_in_stay") == 1, N.first_weekday(F.col("weekday"), arrival))
    # An entry has one style, so one flag at most; arrays are made by cases, which are compiled, as filters of arrays are not.
    flag = (F.when(F.col("style") == "no_stay_dates", F.lit("unparseable_stay_dates"))
            .when(named & first.isNull(), F.lit("date_outside_stay_window"))
            .when(F.col("times_in_stay") > 1, F.lit("ambiguous_weekday"))
            .when(F.col("style") == "none", F.lit("no_date_found_in_note")))
    df = df.withColumns({"day1": F.coalesce(first, weekday_day), "day2": second, "flag": flag,
                         "is_ambiguous": F.col("times_in_stay") > 1})
    one, two = F.col("day1").isNotNull(), F.col("day2").isNotNull()
    df = df.withColumns({
        "days": F.when(one & two, F.array("day1", "day2")).when(one, F.array("day1")).when(two, F.array("day2"))
        .otherwise(F.array().cast("array<date>")),
        "flags": F.when(F.col("flag").isNotNull(), F.array("flag")).otherwise(F.array().cast("array<string>"))})
    keep = [c for c in ("name_key", "arrival", "departure") if c in stays.columns]
    return df.select(
        "stay_seq", *keep, "field_ord", "source_field", "entry_ord", "venue", "time_text",
        "weekday_text", "weekday", "is_ambiguous", "flags",
        F.col("entry").alias("raw_text"),
        F.posexplode_outer("days").alias("date_ord", "resolved_date")
    ).withColumn("date_ord", F.coalesce("date_ord", F.lit(0)))
