"""Severity-ranked report."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import text as T
from ..functions.text import any_of
from ..operators.hints import with_hinted_unit
from ..operators.stays import move_notes
from ..settings import NOTE_FIELDS, Settings
from .publish import children, publish, published
from .shared import cut, once, writing

PAGE_SIZE = 10

LINE_COLUMNS = ["stay_seq", "line_kind", "severity", "reasons", "booking_seq", "mention_ord", "venue",
                "booking_day", "booking_time", "party_size", "booking_name", "set_name", "notes_tags", "detail"]


def _reasons() -> dict:
    """What a booking line is judged by, in order of precedence."""
    has = lambda flag: F.array_contains("flags", flag)
    return {
        "hard": [
            (F.col("status").isin("mismatch", "time_mismatch"), "note_mismatch"),
            (has("surname_only_no_room_hint"), "surname_only"),
            (has("ambiguous_name_match"), "ambiguous")],
        "soft": [
            (has("resolved_by_note_time"), "resolved_by_note"),
            (has("room_mismatch"), "room_mismatch"),
            (has("no_room_hint"), "no_room_hint"),
            (has("party_size_mismatch"), "party_size_mismatch"),
            (F.col("status") == "reservation_without_note", "not_in_notes")]}


def booking_lines(checked: DataFrame) -> DataFrame:
    """One line per matched booking.  A hard conflict stands alone; soft ones add up."""
    rules = _reasons()
    hard = F.coalesce(*[F.when(cond, F.lit(name)) for cond, name in rules["hard"]])
    soft = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in rules["soft"]]))
    said = F.concat_ws(" ", F.lit("the notes say"), F.col("time_text"), F.col("mention_venue"),
                       F.lit("on"), F.col("mention_date").cast("string"))
    conflict = F.when(
        F.col("mismatch_kind") == "time", F.concat(said, F.lit(", the booking is at "), F.col("booking_time"))
    ).when(F.col("mismatch_kind") == "venue", F.concat(
        said, F.lit(", the booking of that day is at "), F.coalesce("venue", F.lit("an unknown venue")))
    ).when(F.col("mismatch_kind") == "date", F.concat(said, F.lit(", the booking is on "), F.col("source_date")))
    party = F.when(F.array_contains("flags", "party_size_mismatch"), F.concat(
        F.lit("party of "), F.col("party_size").cast("string"), F.lit(" booked, "),
        F.col("stay_guests").cast("string"), F.lit(" on the roster")))
    lines = checked.withColumns({"hard": hard, "soft": soft})
    reasons = F.when(F.col("hard").isNotNull(), F.array("hard")).otherwise(F.col("soft"))
    return lines.select(
        "stay_seq", F.lit("booking").alias("line_kind"),
        F.when(F.col("hard").isNotNull(), T.RED).when(F.size("soft") > 0, T.YELLOW)
        .otherwise(T.GREEN).alias("severity"),
        reasons.alias("reasons"), "booking_seq", F.lit(None).cast("int").alias("mention_ord"), "venue",
        "booking_day", "booking_time", "party_size", F.col("guest_name").alias("booking_name"),
        F.col("booking_name").alias("set_name"), "notes_tags",
        F.coalesce(conflict, F.when(F.col("hard").isNull(), party), F.lit("")).alias("detail"))


def line_alternates(lines: DataFrame, alternates_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The other plausible guests of every ambiguous line, as rows.

    A line names its set (set_name, booking_day).  The result has a row per line and guest of its set, which
    grows with the square of a set; lines, names and stays travel once each, the pairs of them never.
    """
    asked = lines.where(F.array_contains("reasons", "ambiguous") | F.array_contains("reasons", "resolved_by_note"))
    asked = asked.select("booking_seq", F.col("stay_seq").alias("line_stay"), F.col("set_name").alias("booking_name"),
                         F.col("booking_day").alias("night"))
    return (alternates_of(asked).where("stay_seq <> line_stay")
            .select(F.col("booking_name").alias("set_name"), F.col("night").alias("booking_day"), "booking_seq",
                    F.col("line_stay").alias("stay_seq"), F.col("stay_seq").alias("alternate_seq"),
                    F.col("guest_name").alias("alternate_name"), "score"))


def mention_lines(checks: DataFrame) -> DataFrame:
    """Mentions that no booking answers."""
    return (checks.where("status = 'note_without_reservation'").select(
        "stay_seq", F.lit("mention").alias("line_kind"), F.lit(T.YELLOW).alias("severity"),
        F.array(F.lit("no_booking_for_note")).alias("reasons"), "mention_ord", "venue",
        F.coalesce("raw_text", F.lit("")).alias("detail")))


def report_lines(stays: DataFrame, checked: DataFrame, checks: DataFrame,
                 duplicates: DataFrame | None = None) -> DataFrame:
    """Booking lines, unanswered mentions, a placeholder for stays with neither,
    and one line per repeated record."""
    found = booking_lines(checked).unionByName(mention_lines(checks), allowMissingColumns=True)
    nothing = (stays.select("stay_seq").join(found.select("stay_seq").distinct(), "stay_seq", "left_anti")
               .select("stay_seq", F.lit("placeholder").alias("line_kind"), F.lit(T.BLUE).alias("severity"),
                       F.array(F.lit("nothing_to_compare")).alias("reasons"), F.lit("").alias("detail")))
    out = found.unionByName(nothing, allowMissingColumns=True)
    if duplicates is not None:
        out = out.unionByName(duplicates.select(
            "stay_seq", F.lit("duplicate").alias("line_kind"), F.lit(T.RED).alias("severity"),
            F.array(F.lit("duplicate_confirmation")).alias("reasons"),
            F.concat(F.lit("copies set aside: "), F.col("occurrences").cast("string")).alias("detail")),
            allowMissingColumns=True)
    return out.select(*LINE_COLUMNS)


def group_notes(members: DataFrame) -> DataFrame:
    """Per member its group and how many other units with a name it has.

    The units themselves are the group's rows in `group_members`, the third table of a
    written report, and as text in `group_cells`: a header never grows with its group.
    """
    sized = members.where("unit <> ''").groupBy("group_id").agg(F.count(F.lit(1)).alias("named_units"))
    return (members.join(sized, "group_id", "left")
            .select("stay_seq", "group_id", "matched_by", "group_size",
                    (F.coalesce("named_units", F.lit(0)) - F.when(F.col("unit") != "", 1).otherwise(0)).alias("other_units")))


def worst_by_stay(checked: DataFrame, checks: DataFrame) -> DataFrame:
    """Worst severity and number of lines per stay that has any."""
    found = (booking_lines(checked).select("stay_seq", "severity")
             .unionByName(mention_lines(checks).select("stay_seq", "severity")))
    return found.groupBy("stay_seq").agg(F.max("severity").alias("worst"), F.count(F.lit(1)).alias("n_lines"))


def report_headers(stays: DataFrame, checked: DataFrame, checks: DataFrame, members: DataFrame,
                   roster_checks: DataFrame, duplicates: DataFrame | None = None) -> DataFrame:
    """One row per stay with its badges, alerts and pointers.

    `base_order` columns (is_duplicate, arrival, stay_seq) carry the report's own order.
    """
    alerts = roster_checks.select(
        "stay_seq", "consortium", "breakfast", "pet",
        F.coalesce(F.col("bed_satisfied"), F.lit(False)).alias("bed_requested"),
        F.coalesce(~F.col("bed_satisfied"), F.lit(False)).alias("bed_alert"),
        F.col("over_capacity_max").alias("capacity_alert"), F.col("pet_violation").alias("pet_alert"))
    about = stays.select("stay_seq", "confirmation_number", "guest_name", "unit", "unit_type", "arrival_date",
                         "departure_date", "guests_count", "arrival", "departure")
    out = (about.join(worst_by_stay(checked, checks), "stay_seq", "left")
           .join(alerts, "stay_seq", "left")
           .join(move_notes(stays), "stay_seq", "left")
           .join(group_notes(members), "stay_seq", "left"))
    move = (F.when(F.col("moved_to_seq").isNotNull(), F.concat(
        F.lit("moves to "), F.col("moved_to_unit"), F.lit(" on "), F.col("departure_date")))
        .when(F.col("moved_from_seq").isNotNull(), F.concat(
            F.lit("moved from "), F.col("moved_from_unit"), F.lit(" on "), F.col("arrival_date"))))
    out = out.select(
        *about.columns, F.coalesce("worst", F.lit(T.BLUE)).alias("severity"),
        F.coalesce("n_lines", F.lit(1)).alias("n_lines"), "consortium", "breakfast", "pet", "bed_requested",
        "bed_alert", "capacity_alert", "pet_alert", move.alias("move_note"), "group_id", "matched_by",
        "group_size", "other_units", F.lit(False).alias("is_duplicate"),
        F.lit(None).cast("bigint").alias("occurrences"))
    if duplicates is not None:
        out = out.unionByName(duplicates.select(
            *about.columns, F.lit(T.RED).alias("severity"), F.lit(1).cast("bigint").alias("n_lines"),
            F.lit(True).alias("is_duplicate"), "occurrences"), allowMissingColumns=True)
    return out


def in_report_order(headers: DataFrame) -> DataFrame:
    """By arrival, unparseable dates last, repeated records at the end."""
    return headers.orderBy("is_duplicate", F.col("arrival").asc_nulls_last(), "stay_seq")


def select_headers(headers: DataFrame, severities: list[int] | None = None,
                   name_contains: str | None = None) -> DataFrame:
    """R5"""
    if severities is not None:
        headers = headers.where(F.col("severity").isin(*severities))
    if name_contains:
        headers = headers.where(F.lower("guest_name").contains(name_contains.lower()))
    return headers


def sort_keys(by: str = "arrival") -> list[Column]:
    """By 'arrival', 'severity' (worst first) or 'name'; ties keep the report's order."""
    first = {"arrival": [], "severity": [F.col("severity").desc()], "name": [F.lower("guest_name").asc()]}[by]
    return [*first, F.col("is_duplicate").asc(), F.col("arrival").asc_nulls_last(), F.col("stay_seq").asc()]


def sort_headers(headers: DataFrame, by: str = "arrival") -> DataFrame:
    return headers.orderBy(*sort_keys(by))


@dataclass
class Pages:
    """Pages of a report whose headers are evaluated once.

    The narrow sort keys are dealt to ranges and written once per order; the number of rows
    of each range is all that comes to the driver.  A page is sought in the one or two ranges it
    lies in, and only the files of these are read.
    """

    headers: DataFrame
    page_size: int = PAGE_SIZE

    @cached_property
    def table(self) -> DataFrame:
        return cut(self.headers, "headers")

    @cached_property
    def _ranges(self) -> dict[str, tuple[DataFrame, list[tuple[int, int]]]]:
        return {}

    def _sorted(self, by: str) -> tuple[DataFrame, list[tuple[int, int]]]:
        """Keys by range, and (range, rows) in order."""
        if by not in self._ranges:
            keys = self.table.select("stay_seq", "is_duplicate", "arrival", "severity", "guest_name")
            ranged = keys.repartitionByRange(*sort_keys(by)).withColumn("range", F.spark_partition_id())
            written = cut(ranged, f"by_{by}", ["range"])
            sizes = written.groupBy("range").agg(F.count(F.lit(1)).alias("n")).orderBy("range").collect()
            self._ranges[by] = written, [(r["range"], r["n"]) for r in sizes]
        return self._ranges[by]

    def page(self, page: int = 1, by: str = "arrival") -> DataFrame:
        """One page, in order; numbers past either end give the first or the last page."""
        written, sizes = self._sorted(by)
        total = sum(n for _, n in sizes)
        page = min(max(1, page), max(1, -(-total // self.page_size)))
        first, last = (page - 1) * self.page_size, page * self.page_size
        spans, start = [], 0
        for number, n in sizes:
            if start < last and start + n > first:
                spans.append((number, first - start, last - start))
            start += n
        nth = F.row_number().over(Window.partitionBy("range").orderBy(*sort_keys(by)))
        here = any_of([(F.col("range") == r) & (F.col("nth") > lo) & (F.col("nth") <= hi) for r, lo, hi in spans])
        keys = written.where(F.col("range").isin([r for r, _, _ in spans])).withColumn("nth", nth).where(here)
        chosen = self.table.join(keys.select("stay_seq", "is_duplicate"), ["stay_seq", "is_duplicate"], "left_semi")
        return sort_headers(chosen, by)


def page_of(headers: DataFrame, page: int = 1, by: str = "arrival", page_size: int = PAGE_SIZE) -> DataFrame:
    """One page; who asks for several keeps the `Pages`."""
    return Pages(headers, page_size).page(page, by)


def summary(headers: DataFrame, moves: DataFrame, members: DataFrame) -> DataFrame:
    """One row of totals."""
    counts = headers.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("severity") == n).alias(name.lower()) for n, name in T.SEVERITY_NAMES.items()])
    n_moves = moves.agg(F.coalesce(F.sum("n_moves"), F.lit(0)).alias("n")).scalar()
    n_groups = members.select("group_id").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    return counts.select("*", n_moves.alias("unit_moves"), n_groups.alias("group_bookings"))


def note_profile(stays: DataFrame) -> DataFrame:
    """K3: what the notes look like without their content."""
    flags = F.col("flags") if "flags" in stays.columns else F.array().cast("array<string>")
    return stays.select(
        "stay_seq", F.right("confirmation_number", F.lit(4)).alias("confirmation_tail"),
        *[F.length(f).alias(f"{f}_length") for f in NOTE_FIELDS],
        T.requests_extra_bed(T.all_notes()).alias("bed_request"), flags.alias("flags"))


def display_fields(bookings: DataFrame, settings: Settings) -> DataFrame:
    """F36, F38 of bookings."""
    return with_hinted_unit(bookings, settings).select(
        "booking_seq", T.evening_clock(F.col("booking_time")).alias("shown_time"),
        T.shown_unit(F.col("is_outside"), F.col("unit_hint"), F.col("hinted_unit")).alias("shown_unit"))


def group_cells(members: DataFrame, size: int = 64) -> DataFrame:
    """(group_id, cell, units): the units of a group as text, `size` of them in a numbered cell, blank ones left out.

    A group's cells in order, joined by ", ", are its whole list, at any size.  Places are counted
    in ranges of (group, stay), so a group that holds most stays is spread over tasks.
    """
    named = members.where("unit <> ''").select("group_id", "stay_seq", "unit")
    ranged = cut(named.repartitionByRange("group_id", "stay_seq").withColumn("range", F.spark_partition_id()), "group_ranges")
    counts = ranged.groupBy("group_id", "range").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("group_id").orderBy("range")) - F.col("n")
    inside = F.row_number().over(Window.partitionBy("group_id", "range").orderBy("stay_seq"))
    placed = ranged.withColumn("inside", inside).join(counts.select("group_id", "range", before.alias("before")), ["group_id", "range"])
    place = F.col("before") + F.col("inside") - 1
    units = F.array_sort(F.collect_list(F.struct(place.alias("place"), "unit")))
    return (placed.groupBy("group_id", F.floor(place / size).cast("long").alias("cell"))
            .agg(F.array_join(F.transform(units, lambda u: u["unit"]), ", ").alias("units")))


# --- K2: a report as files -------------------------------------------------------------

PREFIX = "report-"


def write_report(tables: dict[str, DataFrame], stays: DataFrame, path: str, fmt: str = "parquet", keep_other_months: bool = False) -> str:
    """K2: publish `tables` (name -> rows with a stay_seq) below `path`, split by the arrival month of their stay
    in `stays` (stay_seq, arrival), in report order inside.

    A report is written aside, with a manifest of its months and rows, and published by one rename; a
    run that fails leaves the report before as it was, and a run that is repeated replaces
    itself.  With `keep_other_months`, months this run has no row of stay as they were: the manifest
    points to the reports that hold them.
    """
    spark = stays.sparkSession
    month = F.coalesce(F.date_format("arrival", "yyyy-MM"), F.lit("unknown")).alias("arrival_month")
    months = stays.select("stay_seq", month).dropDuplicates(["stay_seq"])
    before = published(spark, path, PREFIX)
    version = f"{PREFIX}{sum(n.startswith(PREFIX) for n in children(spark, path)):08d}"

    def write(folder: str) -> None:
        def written(name: str, df: DataFrame) -> DataFrame:
            arrays = [c for c, t in df.dtypes if t.startswith("array")] if fmt == "csv" else []
            flat = df.withColumns({c: F.array_join(c, ";") for c in arrays}) if arrays else df
            keys = [c for c in ("is_duplicate", "arrival", "group_id", "stay_seq", "line_kind", "booking_seq", "mention_ord") if c in df.columns]
            # Ranges are drawn over a written table, so nothing is evaluated twice; they end inside a stay if need be.
            out = cut(flat.join(months, "stay_seq"), name)
            ranged = out.repartitionByRange("arrival_month", *keys).sortWithinPartitions("arrival_month", *keys)
            with writing(spark):
                ranged.write.partitionBy("arrival_month").option("header", True).format(fmt).save(f"{folder}/{name}")
            return out.groupBy("arrival_month").agg(F.count(F.lit(1)).alias("n_rows")).select(
                F.lit(name).alias("table_name"), "arrival_month", F.lit(version).alias("version"), "n_rows")

        # A table that is written goes; a row per month of it stays.
        held = reduce(DataFrame.unionByName, [once(lambda: written(name, df), "report_rows") for name, df in tables.items()])  # noqa: B023
        if keep_other_months and before:
            held = held.unionByName(manifest(spark, path).join(held.select("arrival_month").distinct(), "arrival_month", "left_anti"))
        held.coalesce(1).write.parquet(f"{folder}/manifest")  # a row per table and month

    return publish(spark, path, version, write)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(table_name, arrival_month, version, n_rows) of the report that was published last."""
    return spark.read.parquet(f"{published(spark, path, PREFIX)}/manifest")


def read_report(spark: SparkSession, path: str, table: str, fmt: str = "parquet") -> DataFrame:
    """A table of the report that was published last, with arrival_month."""
    held: dict[str, list[str]] = {}
    for r in manifest(spark, path).where(F.col("table_name") == table).collect():  # a row per month
        held.setdefault(r["version"], []).append(r["arrival_month"])
    parts = []
    for version, months in sorted(held.items()):
        rows = spark.read.option("header", True).format(fmt).load(f"{path}/{version}/{table}")
        parts.append(rows.withColumn("arrival_month", F.col("arrival_month").cast("string")).where(F.col("arrival_month").isin(months)))
    return reduce(DataFrame.unionByName, parts)
