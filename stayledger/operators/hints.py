"""The unit a booking's hint names."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as T
from ..settings import Settings


def hinted_units(bookings: DataFrame, settings: Settings) -> DataFrame:
    """(unit_hint, hinted_unit) for every distinct hint that names a unit.

    The tokens of a hint meet the directory by equality, so the work does not depend on
    its size; the first token that is known decides.
    """
    hints = bookings.where("unit_hint IS NOT NULL").select("unit_hint").distinct()
    tokens = hints.select("unit_hint", F.posexplode(T.hint_tokens(T.clean_hint(F.col("unit_hint")))).alias("pos", "token"))
    return (tokens.join(settings.aliases(bookings.sparkSession), "token")
            .groupBy("unit_hint").agg(F.min_by("unit", "pos").alias("hinted_unit")))


def with_hinted_unit(bookings: DataFrame, settings: Settings) -> DataFrame:
    return bookings.join(hinted_units(bookings, settings), "unit_hint", "left")
