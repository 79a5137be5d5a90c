"""Resolve every booking to a stay.

A booking's candidates depend only on its (name, day), and a stay is a candidate only
through its name and nights.  So candidates are never paired one by one: stays are
counted per (name, night), names are scored per distinct pair, and both meet at the
distinct (booking name, day) - the "set" of a booking.  Ranking, ties, near ties and
group collapse need only counts, minima and the scores, all of which combine on the map
side.  Bookings take part in one join, with the finished set.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from ..functions import notes as N
from ..functions import text as T
from ..settings import Settings
from ..plans.shared import cut
from .hints import hinted_units
from .names import score_all_names, score_names
from .stays import CLASS, OCCUPIED, cover, occupancy, occupied_spans, on_nights, top_level, under_nodes

SET = ["booking_name", "night"]


@dataclass
class Matching:
    """Lazy results of matching: a shared table is written when it is first asked for."""

    stays: DataFrame
    bookings: DataFrame
    mentions: Callable[[], DataFrame]
    settings: Settings
    stay_classes: Callable[[], DataFrame]

    @property
    def classes(self) -> DataFrame:
        return self.stay_classes()

    @cached_property
    def wanted(self) -> DataFrame:
        return cut(wanted_sets(self.bookings), "wanted_sets")

    @cached_property
    def name_scores(self) -> DataFrame:
        return cut(score_names(*present_spans(self.stays, self.wanted), self.settings), "name_scores")

    @property
    def all_name_scores(self) -> DataFrame:
        """The scores of all names, also of those that never share a night: matching reads `name_scores`."""
        booked = self.wanted.select(F.col("booking_name").alias("name")).distinct()
        return score_all_names(self.stays.select(F.col("name_key").alias("name")).distinct(), booked, self.settings)

    @cached_property
    def all_candidates(self) -> DataFrame:
        return cut(candidate_names(self.classes, self.wanted, self.name_scores), "candidates")

    @cached_property
    def ranked(self) -> DataFrame:
        return cut(rank_sets(self.all_candidates, self.settings), "ranked_sets")

    @cached_property
    def candidates(self) -> DataFrame:
        """The plausible names of the ambiguous sets."""
        return cut(plausible_names(self.all_candidates, self.ranked, self.settings), "plausible_names")

    @cached_property
    def sets(self) -> DataFrame:
        return _attributed(self)

    @cached_property
    def matches(self) -> DataFrame:
        return _resolve(self.bookings, self.sets, self.settings)


def eligible(bookings: DataFrame) -> DataFrame:
    """M1, M2: bookings that may match at all."""
    return bookings.where(F.col("booking_day").isNotNull() & ~F.col("is_outside"))


def wanted_sets(bookings: DataFrame) -> DataFrame:
    """Distinct (booking name, day) of the bookings that may match."""
    return eligible(bookings).select("booking_name", F.col("booking_day").alias("night")).distinct()


def present_spans(stays: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spans of nights of every stay name and of every booking name."""
    spans = occupied_spans(stays, wanted).select(F.col("name_key").alias("name"), "from_day", "to_day")
    return spans, wanted.select(F.col("booking_name").alias("name"), F.col("night").alias("from_day"), F.col("night").alias("to_day"))


def candidate_names(classes: DataFrame, wanted: DataFrame, name_scores: DataFrame) -> DataFrame:
    """J1 + J2: per (booking name, day) the stay names in house with their counts.

    Days meet the nodes of stays by equality, so the length of a stay does not count.  A full
    name means few stay names, so its days are looked up one by one.  A bare surname can mean
    very many; it starts from the nodes that really are occupied, which keeps (days of the
    surname) x (names it can mean) from being spelled out.
    """
    meant = name_scores.select(F.col("stay_name").alias("name_key")).distinct()
    known = classes.join(meant, "name_key", "left_semi")
    nodes = occupancy(known, wanted).withColumnRenamed("name_key", "stay_name")
    under = under_nodes(wanted, top_level(occupied_spans(classes, wanted)))
    bare = T.is_bare(F.col("booking_name"))
    columns = [*SET, "stay_name", "score", *OCCUPIED]
    by_day = under.join(name_scores.where(~bare), "booking_name").join(nodes, ["stay_name", "node"]).select(*columns)
    by_node = name_scores.where(bare).join(nodes, "stay_name").join(under, ["booking_name", "node"]).select(*columns)
    return on_nights(by_day.unionByName(by_node), [*SET, "stay_name", "score"])


def rank_sets(candidates: DataFrame, settings: Settings) -> DataFrame:
    """M3-M7, M9: one row per (booking name, day) with the leader and the ambiguity.

    Candidates are first folded by score, so a set carries one entry per distinct score
    and not one per stay.
    """
    levels = candidates.groupBy(*SET, "score").agg(
        F.sum("n").alias("n"), F.min("first_seq").alias("first_seq"),
        F.min("group_lo").alias("group_lo"), F.max("group_hi").alias("group_hi"),
        F.sum("n_grouped").alias("n_grouped"))
    ranked = levels.groupBy(*SET).agg(F.sort_array(F.collect_list(F.struct(
        "score", "n", "first_seq", "group_lo", "group_hi", "n_grouped")), asc=False).alias("levels"))
    top, second = F.element_at("levels", 1), F.try_element_at("levels", F.lit(2))
    near = F.filter("levels", lambda x: top["score"] - x["score"] < settings.ambiguity_margin)
    ranked = ranked.select(
        *SET, top["score"].alias("top_score"), top["first_seq"].alias("leader_seq"),
        top["n"].alias("n_top"),
        F.coalesce((top["n_grouped"] == top["n"]) & (top["group_lo"] == top["group_hi"]),
                   F.lit(False)).alias("one_group"),
        F.coalesce(top["score"] - second["score"] < settings.ambiguity_margin,
                   F.lit(False)).alias("close_second"),
        F.aggregate(near, F.lit(0).cast("bigint"), lambda acc, x: acc + x["n"]).alias("n_near"))
    tied = (F.col("n_top") > 1) & ~F.col("one_group")
    near_tie = (F.col("n_top") == 1) & ~F.col("one_group") & F.col("close_second")
    return ranked.select(
        *SET, "top_score", "leader_seq",
        F.when(tied, "tied").when(near_tie, "near_tie").otherwise("clear").alias("outcome"),
        F.when(tied, F.col("n_top")).when(near_tie, F.col("n_near")).otherwise(1).alias("n_plausible"))


def plausible_names(candidates: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """M7: the stay names of the ambiguous sets that count as plausible."""
    ambiguous = sets.where("outcome <> 'clear'").select(*SET, "outcome", "top_score", "leader_seq")
    gap = F.col("top_score") - F.col("score")
    return candidates.join(ambiguous, SET).where(
        (gap == 0) | ((F.col("outcome") == "near_tie") & (gap < settings.ambiguity_margin)))


def agreeing_stays(mentions: DataFrame, plausible: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per ambiguous set and (venue, time) the stay whose notes alone agree.

    Mentions are counted per (name, day, venue, time) before they meet the sets.  The days
    of an ambiguous weekday are those of the stay that bookings can be for.
    """
    lo, hi = (wanted.agg(f("night").alias("d")).scalar() for f in (F.min, F.max))
    from_day, end = F.greatest("arrival", lo), F.least("departure", F.date_add(hi, 1))
    dates = F.when(F.col("resolved_date").isNotNull(), F.array("resolved_date")).when(
        F.col("is_ambiguous") & (from_day < end), N.weekday_dates(F.col("weekday"), from_day, end))
    timed = (mentions.withColumn("note_clock", T.clock(F.col("time_text")))
             .where(F.col("note_clock").isNotNull())
             .select("name_key", "stay_seq", "venue", "note_clock", "arrival", "departure",
                     F.explode(dates).alias("night"))
             .where((F.col("night") >= F.col("arrival")) & (F.col("night") < F.col("departure"))))
    said = (timed.groupBy("name_key", "night", "venue", "note_clock", "stay_seq").agg(F.lit(1).alias("one"))
            .groupBy(F.col("name_key").alias("stay_name"), "night", "venue", "note_clock")
            .agg(F.count(F.lit(1)).alias("n_stays"), F.min("stay_seq").alias("stay_seq")))
    return (plausible.select(*SET, "stay_name").join(said, ["stay_name", "night"])
            .groupBy(*SET, "venue", "note_clock")
            .agg(F.sum("n_stays").alias("n_stays"), F.min("stay_seq").alias("chosen_seq"))
            .where("n_stays = 1").drop("n_stays"))


def _attributed(m: Matching) -> DataFrame:
    """The ranked sets with what their bookings need to know."""
    stays, classes, ranked, settings = m.stays, m.classes, m.ranked, m.settings
    # Attributes of the leading stay; its group by the class it belongs to.
    grouped = classes.where("group_id IS NOT NULL").select(*CLASS, "group_id", "group_size")
    attributes = (stays.select("stay_seq", *CLASS, "unit", "guests_count", "mention_bound")
                  .join(grouped, CLASS, "left")
                  .select("stay_seq", T.strip(F.col("unit")).alias("stay_unit"), "guests_count",
                          "mention_bound", "group_id", "group_size"))
    # A group's units are those of the directory, so the set is bounded by the directory.
    codes = settings.units_table(stays.sparkSession).where("abbreviation IS NOT NULL").select(F.col("abbreviation").alias("code"))
    group_units = (attributes.where("group_id IS NOT NULL")
                   .select("group_id", F.upper("stay_unit").alias("code")).distinct().join(codes, "code")
                   .groupBy("group_id").agg(F.collect_set("code").alias("group_units")))
    leaders = (ranked.join(attributes.withColumnRenamed("stay_seq", "leader_seq"), "leader_seq")
               .join(group_units, "group_id", "left"))

    # Settled ties hang on the set: at most one entry per venue and clock time.
    settled = (agreeing_stays(m.mentions(), m.candidates, m.wanted)
               .join(attributes.select(F.col("stay_seq").alias("chosen_seq"), "mention_bound",
                                       "group_id", "group_size"), "chosen_seq")
               .groupBy(*SET).agg(F.collect_list(F.struct(
                   "venue", "note_clock", "chosen_seq", "mention_bound", "group_id",
                   "group_size")).alias("settled")))
    return leaders.join(settled, SET, "left")


def _resolve(bookings: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """Join every booking with its set and apply M1-M3, M8, M10-M14.

    Bookings that cannot match get a key of their own, so they neither pile up on one
    reducer nor need a second scan.
    """
    may_match = F.col("booking_day").isNotNull() & ~F.col("is_outside")
    keyed = bookings.select(
        "booking_seq", "guest_name", "booking_name", "booking_day", "source_date", "booking_time",
        "party_size", "venue", "is_outside", "unit_hint", "notes_tags",
        T.clock(F.col("booking_time")).alias("booking_clock"),
        T.is_bare(F.col("booking_name")).alias("bare"),
        F.when(may_match, F.col("booking_name")).otherwise(
            F.concat(F.lit("\u0000"), F.col("booking_seq").cast("string"))).alias("set_name"))
    keyed = keyed.join(hinted_units(bookings, settings), "unit_hint", "left")
    s = sets.select(F.col("booking_name").alias("set_name"), F.col("night").alias("booking_day"),
                    "top_score", "leader_seq", "outcome", "n_plausible", "stay_unit", "guests_count",
                    "mention_bound", "group_id", "group_size", "group_units", "settled")
    j = keyed.join(s, ["set_name", "booking_day"], "left")
    pick = F.try_element_at(F.filter("settled", lambda x: (x["venue"] == F.col("venue"))
                                     & (x["note_clock"] == F.col("booking_clock"))), F.lit(1))
    j = j.withColumn("pick", F.when(F.col("outcome") != "clear", pick))
    matched, clear = F.col("leader_seq").isNotNull(), F.col("outcome") == "clear"
    by_note = F.col("pick").isNotNull()
    own = F.upper("stay_unit")
    elsewhere = (F.col("hinted_unit").isNotNull() & (F.col("stay_unit") != "")
                 & (F.col("hinted_unit") != own)
                 & ~F.coalesce(F.array_contains("group_units", F.col("hinted_unit")), F.lit(False)))
    no_hint = F.col("hinted_unit").isNull()
    flags = F.array_compact(F.array(
        F.when(F.col("booking_day").isNull(), F.lit("unparseable_reservation_date"))
        .when(F.col("is_outside"), F.lit("outside_guest"))
        .when(~matched, F.lit("no_match_found")),
        F.when(matched & ~clear, F.when(by_note, F.lit("resolved_by_note_time"))
               .otherwise(F.lit("ambiguous_name_match"))),
        F.when(clear & elsewhere, F.lit("room_mismatch")),
        F.when(clear & no_hint, F.when(F.col("bare"), F.lit("surname_only_no_room_hint"))
               .otherwise(F.lit("no_room_hint"))),
        F.when(clear & (F.col("party_size") != F.col("guests_count")), F.lit("party_size_mismatch"))))

    def of_chosen(name: str):
        return F.when(by_note, F.col("pick")[name]).otherwise(F.col(name))

    return j.select(
        "booking_seq", "guest_name", "booking_name", "booking_day", "source_date", "booking_time",
        "booking_clock", "party_size", "venue", "is_outside", "unit_hint", "hinted_unit", "notes_tags",
        F.when(matched, "name").otherwise("none").alias("match_method"),
        F.when(by_note, F.col("pick.chosen_seq")).otherwise(F.col("leader_seq")).alias("stay_seq"),
        F.col("top_score").alias("confidence"), flags.alias("flags"),
        F.when(matched & ~clear, F.col("n_plausible") - 1).when(matched, 0).alias("n_alternates"),
        F.when(clear, F.col("guests_count")).alias("stay_guests"),
        of_chosen("mention_bound").alias("mention_bound"),
        of_chosen("group_id").alias("group_id"), of_chosen("group_size").alias("group_size"))


def unmatched(matches: DataFrame) -> DataFrame:
    """Bookings without a stay, with the reason."""
    return (matches.where("match_method = 'none'")
            .select("booking_seq", "guest_name", "source_date", F.element_at("flags", 1).alias("reason")))


def alternates(stays: DataFrame, plausible: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """M8: the plausible stays of every ambiguous (booking name, day), best first by
    (score desc, stay_seq).

    Keyed by the set, not by the booking: all bookings of a set share its list, and a
    booking's alternates are the rows of its set other than the stay it was given.  With `asked`
    (booking_name, night, ...), the list of every row of it, with its columns: rows meet the names of their set
    before these meet stays, so the last join makes the result and lists are never shuffled.
    """
    inside = stays.select("stay_seq", F.col("name_key").alias("stay_name"), "guest_name", "arrival", "departure")
    names = plausible.select(*SET, "stay_name", "score", "leader_seq")
    # Nights meet the nodes of stays by equality, so a pair that is joined is a row of the result.
    spans = occupied_spans(inside, names)
    spread = spans.select("stay_seq", "stay_name", "guest_name", F.explode(cover("from_day", "to_day")).alias("node"))
    own = [] if asked is None else [c for c in asked.columns if c not in SET]
    names = names if asked is None else asked.join(names, SET)
    return (under_nodes(names, top_level(spans)).join(spread, ["stay_name", "node"])
            .select(*SET, *own, "stay_seq", "guest_name", "score", (F.col("stay_seq") == F.col("leader_seq")).alias("is_leader")))
