"""Stay-side relations: groups, occupancy, moves, duplicates and roster checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from ..plans.shared import cut
from ..settings import Settings, one_row_each

CLASS = ["name_key", "arrival_date", "departure_date"]


# --- G1-G3: group bookings -----------------------------------------------------------

def stay_classes(stays: DataFrame) -> DataFrame:
    """One row per (name, arrival, departure) with its group, if it belongs to one.

    Stays that agree on the three are one group by exact name.  A class of a single stay
    joins the others of its surname and dates.  Only aggregates are shuffled, so a class
    holding a large share of all stays is still one row.
    """
    classes = stays.groupBy(*CLASS, "arrival", "departure").agg(
        F.count(F.lit(1)).alias("n"), F.min("stay_seq").alias("first_seq"))
    classes = classes.withColumn("family", T.group_surname(F.col("name_key")))
    families = (classes.where("n = 1")
                .groupBy("family", "arrival_date", "departure_date")
                .agg(F.count(F.lit(1)).alias("family_n"), F.min("first_seq").alias("family_seq"))
                .where("family_n > 1"))
    in_family = (F.col("n") == 1) & F.col("family_n").isNotNull()
    return (classes.join(families, ["family", "arrival_date", "departure_date"], "left")
            .select(*CLASS, "arrival", "departure", "n", "first_seq",
                    F.when(F.col("n") > 1, F.col("first_seq"))
                    .when(in_family, F.col("family_seq")).alias("group_id"),
                    F.when(F.col("n") > 1, F.lit("exact_name"))
                    .when(in_family, F.lit("same_surname")).alias("matched_by"),
                    F.when(F.col("n") > 1, F.col("n"))
                    .when(in_family, F.col("family_n")).alias("group_size")))


def group_members(stays: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """(group_id, matched_by, group_size, stay_seq, unit, guest_name): flat membership.

    The members' pointer to each other (J7) is this table itself: siblings are the rows
    of the same group_id, so nothing quadratic in the group size is ever built.
    """
    classes = stay_classes(stays) if classes is None else classes
    grouped = classes.where("group_id IS NOT NULL").select(*CLASS, "group_id", "matched_by", "group_size")
    return (stays.join(grouped, CLASS)
            .select("group_id", "matched_by", "group_size", "stay_seq", "unit", "guest_name"))


# --- J1: who is in house on which night ----------------------------------------------

def occupied_spans(classes: DataFrame, days: DataFrame) -> DataFrame:
    """The classes with the first and last of their nights (from_day, to_day) that can match.

    `days(night)` are the days that have bookings.  Nights outside them cannot match and
    are cut off, which also bounds stays with absurd departure dates.
    """
    lo, hi = (days.agg(f("night").alias("d")).scalar() for f in (F.min, F.max))
    from_day = F.greatest(F.col("arrival"), lo)
    to_day = F.least(F.date_sub(F.col("departure"), 1), hi)
    return (classes.where(F.col("arrival").isNotNull() & F.col("departure").isNotNull())
            .withColumns({"from_day": from_day, "to_day": to_day})
            .where(F.col("from_day") <= F.col("to_day")))


# Nights as nodes of a binary tree over the days: node (level, i) stands for the days from i * 2^level
# on, 2^level of them.  A span of nights is covered by at most two nodes a level, and a day lies under
# one node a level, so neither side spells out nights and both meet by equality.

def _node(level: str, i: str) -> str:
    return f"shiftleft({i}, 6) | {level}"


def cover(from_day: str, to_day: str) -> Column:
    """Nodes whose days are exactly those from `from_day` to `to_day`, both included."""
    lo, hi = f"CAST(unix_date({from_day}) AS BIGINT)", f"(CAST(unix_date({to_day}) AS BIGINT) + 1)"
    levels = f"sequence(0, CAST(floor(log2({hi} - {lo})) AS INT))"
    at = f"named_struct('l', shiftright({lo} + shiftleft(1L, j) - 1, j), 'r', shiftright({hi}, j))"
    nodes = (f"array(if(x.l < x.r AND x.l & 1 = 1, {_node('j', 'x.l')}, NULL), "
             f"if(x.l < x.r AND x.r & 1 = 1, {_node('j', '(x.r - 1)')}, NULL))")
    return F.expr(f"array_compact(flatten(transform({levels}, j -> transform(array({at}), x -> {nodes})[0])))")


def under_nodes(days: DataFrame, levels: Column) -> DataFrame:
    """`days(night, ...)` once for every node over the night, up to the given level."""
    return (days.withColumn("level", F.explode(F.sequence(F.lit(0), levels)))
            .withColumn("node", F.expr(_node("level", "shiftright(CAST(unix_date(night) AS BIGINT), level)"))).drop("level"))


def top_level(spans: DataFrame) -> Column:
    """Level of the largest node that the longest span can have."""
    return spans.agg(F.coalesce(F.floor(F.log2(F.max(F.datediff("to_day", "from_day")) + 1)), F.lit(0)).cast("int").alias("n")).scalar()


OCCUPIED = {"n": F.sum, "first_seq": F.min, "group_lo": F.min, "group_hi": F.max, "n_grouped": F.sum}


def occupancy(classes: DataFrame, days: DataFrame) -> DataFrame:
    """Per (name, node): how many stays cover it, the first of them, and their groups.

    What a name has on a night is the sum, or the least, of the nodes over it; see `on_nights`.
    """
    grouped = F.when(F.col("group_id").isNotNull(), F.col("n")).otherwise(0)
    return (occupied_spans(classes, days)
            .select("name_key", "n", "first_seq", F.col("group_id").alias("group_lo"), F.col("group_id").alias("group_hi"),
                    grouped.alias("n_grouped"), F.explode(cover("from_day", "to_day")).alias("node"))
            .groupBy("name_key", "node").agg(*[f(c).alias(c) for c, f in OCCUPIED.items()]))


def on_nights(found: DataFrame, keys: list[str]) -> DataFrame:
    """Sum up the nodes over each night: one row per `keys`."""
    return found.groupBy(*keys).agg(*[f(c).alias(c) for c, f in OCCUPIED.items()])


def inhouse_counts(classes: DataFrame, bookings: DataFrame) -> DataFrame:
    """J1 per booking: number of stays in house on its day and the first of them.

    A stay is a few nodes whatever its length; nodes are counted before they meet the days.
    """
    dated = bookings.where("booking_day IS NOT NULL").select("booking_seq", F.col("booking_day").alias("night"))
    days = cut(dated.select("night").distinct(), "booking_days")
    spans = occupied_spans(classes, days)
    nodes = (spans.select("n", "first_seq", F.explode(cover("from_day", "to_day")).alias("node"))
             .groupBy("node").agg(F.sum("n").alias("n"), F.min("first_seq").alias("first_seq")))
    nightly = (under_nodes(days, top_level(spans)).join(nodes, "node")
               .groupBy("night").agg(F.sum("n").alias("in_house"), F.min("first_seq").alias("first_stay")))
    return (dated.join(nightly, "night")
            .select("booking_seq", "in_house", "first_stay"))


# --- J6, G8: unit moves --------------------------------------------------------------

def _move_sides(stays: DataFrame) -> tuple[DataFrame, DataFrame]:
    def side(day: str, prefix: str) -> DataFrame:
        return (stays.groupBy("name_key", F.col(day).alias("move_date"),
                              F.col("unit").alias(f"{prefix}_unit"),
                              F.col("unit_type").alias(f"{prefix}_type"))
                .agg(F.count(F.lit(1)).alias(f"{prefix}_n"),
                     F.max("stay_seq").alias(f"{prefix}_seq")))
    return side("departure_date", "earlier"), side("arrival_date", "later")


def unit_moves(stays: DataFrame) -> DataFrame:
    """Moves by (name, day, unit and type left, unit and type entered).

    A row stands for `earlier_n * later_n` moves; usually both are 1 and `earlier_seq`,
    `later_seq` are the move itself, otherwise they are the last stays of either side.
    Repeated stays are counted before the self join, never paired with each other.
    """
    earlier, later = _move_sides(stays)
    return (earlier.join(later, ["name_key", "move_date"])
            .where((F.col("earlier_unit") != F.col("later_unit"))
                   & (F.col("earlier_type") != F.col("later_type")))
            .withColumn("n_moves", F.col("earlier_n") * F.col("later_n")))


def move_notes(stays: DataFrame, moves: DataFrame | None = None) -> DataFrame:
    """G8 per stay: the last move it starts and the last move it ends.

    `moved_to_*` (this stay is left for another) outranks `moved_from_*`.
    """
    moves = unit_moves(stays) if moves is None else moves
    left = (moves.groupBy("name_key", F.col("move_date").alias("departure_date"),
                          F.col("earlier_unit").alias("unit"), F.col("earlier_type").alias("unit_type"))
            .agg(F.max("later_seq").alias("moved_to_seq"),
                 F.max_by("later_unit", "later_seq").alias("moved_to_unit")))
    entered = (moves.groupBy("name_key", F.col("move_date").alias("arrival_date"),
                             F.col("later_unit").alias("unit"), F.col("later_type").alias("unit_type"))
               .agg(F.max("earlier_seq").alias("moved_from_seq"),
                    F.max_by("earlier_unit", "earlier_seq").alias("moved_from_unit")))
    base = stays.select("stay_seq", "name_key", "arrival_date", "departure_date", "unit", "unit_type")
    return (base.join(left, ["name_key", "departure_date", "unit", "unit_type"], "left")
            .join(entered, ["name_key", "arrival_date", "unit", "unit_type"], "left")
            .where("moved_to_seq IS NOT NULL OR moved_from_seq IS NOT NULL")
            .select("stay_seq", "moved_to_seq", "moved_to_unit", "moved_from_seq", "moved_from_unit"))


# --- G4, G5: repeated confirmation numbers -------------------------------------------

def mark_copies(stays: DataFrame) -> DataFrame:
    """Stays with `occurrences`: null for the first of a confirmation number, else how many later copies
    that number has.  Blank numbers are first-seen each, and get a key of their own so they don't gather.
    """
    number = F.when(F.col("confirmation_number") != "", F.concat(F.lit("#"), "confirmation_number")).otherwise(F.col("stay_seq").cast("string"))
    seen = Window.partitionBy("_number")
    return (stays.withColumn("_number", number)
            .withColumns({"_first": F.min("stay_seq").over(seen), "_n": F.count(F.lit(1)).over(seen)})
            .withColumn("occurrences", F.when(F.col("stay_seq") != F.col("_first"), F.col("_n") - 1))
            .drop("_number", "_first", "_n"))


# --- J8-J10, F27, F28: roster checks -------------------------------------------------

BADGES = ["consortium", "breakfast", "pet", "bed_request"]


def note_badges() -> dict[str, Column]:
    """what the notes of a stay say about it."""
    text = T.all_notes()
    return {"consortium": T.has_consortium_perk(text), "breakfast": T.has_breakfast(text), "pet": T.has_pet(text),
            "bed_request": T.requests_extra_bed(text)}


def stay_checks(stays: DataFrame, units: DataFrame, settings: Settings) -> DataFrame:
    """Perk badges and unit rule violations, one row per stay; `stays` have their badges.

    `units` has one row per abbreviation; being a directory it is small enough for the
    optimizer to broadcast by its size, so stays do not move.
    """
    u = units.where(F.col("abbreviation").isNotNull()).select(
        F.col("abbreviation").alias("unit_code"), "category", "max_guests", "has_sofa_bed")
    base = stays.select("stay_seq", "guests_count", T.strip(F.col("unit")).alias("unit_code"), *BADGES)
    j = base.join(u, "unit_code", "left")
    known = F.col("category").isNotNull()
    over = F.col("guests_count") > F.col("max_guests")
    return j.select(
        "stay_seq", *BADGES,
        F.when(over, F.col("max_guests")).alias("over_capacity_max"),
        F.when(over, F.col("guests_count")).alias("over_capacity_guests"),
        F.when(F.col("bed_request") & known, F.col("has_sofa_bed")).alias("bed_satisfied"),
        F.when(F.col("pet") & known & (F.col("category") != F.lit(settings.pet_category)),
               F.col("category")).alias("pet_violation"))


def find_units(df: DataFrame, units: DataFrame, code: str | None = None,
               name: str | None = None) -> DataFrame:
    """Look a unit up by abbreviation (exact) or by full name (trimmed,
    case-blind; of units of one name the least row), so no row of `df` is doubled."""
    if code is not None:
        return df.join(units, F.col(code) == F.col("abbreviation"), "left")
    key = F.lower(T.strip(F.col("full_name")))
    return df.join(one_row_each(units.where(F.col("full_name").isNotNull()), key), F.lower(T.strip(F.col(name))) == key, "left")
