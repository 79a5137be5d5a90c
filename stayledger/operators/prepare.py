"""Add derived columns to raw stays and bookings (one projection, no data movement)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as T
from ..functions.notes import mention_bound
from ..settings import NOTE_FIELDS, Settings

STAY_TEXT = ("confirmation_number", "guest_name", "unit", "unit_type", "status",
             "arrival_date", "departure_date", *NOTE_FIELDS)


def _with_missing(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Absent optional columns become nulls of the right type."""
    have = set(df.columns)
    new = {c: F.lit(None).cast(t) for c, t in columns.items() if c not in have}
    return df.withColumns(new) if new else df


def prepare_stays(stays: DataFrame, settings: Settings) -> DataFrame:
    """F1, F7 inputs: parsed dates, name key, and a bound on the mentions in the notes."""
    df = _with_missing(stays, {**{c: "string" for c in STAY_TEXT},
                               "guests_count": "int", "guests_share": "int"})
    df = df.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in STAY_TEXT})
    return df.withColumns({
        "name_key": T.name_key(F.col("guest_name")),
        "arrival": T.stay_date(F.col("arrival_date")),
        "departure": T.stay_date(F.col("departure_date")),
        "mention_bound": sum((mention_bound(F.col(f), settings) for f in NOTE_FIELDS), F.lit(0)),
    })


def prepare_bookings(bookings: DataFrame, settings: Settings) -> DataFrame:
    """Booking day, venue, outside flag and unit hint from the tags."""
    df = _with_missing(bookings, {"booking_time": "string", "party_size": "int",
                                  "notes_tags": "string", "phone": "string"})
    tags = F.coalesce(F.col("notes_tags"), F.lit(""))
    derived = {"venue": T.venue_of(tags, settings), "unit_hint": T.unit_hint(tags, settings),
               "is_outside": T.is_outside(tags, settings)}
    df = df.withColumns({c: e for c, e in derived.items() if c not in df.columns})
    return df.withColumns({
        "booking_name": T.name_key(F.col("guest_name")),
        "booking_day": T.booking_date(F.col("source_date")),
        "flags": F.array_compact(F.array(
            F.when(F.col("venue").isNull(), F.lit("no_restaurant_detected")))),
    })
