"""The whole reconciliation: stays and bookings in, report out."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from ..operators import crosscheck as C
from ..operators import matching as M
from ..operators.mentions import note_mentions
from ..operators.prepare import prepare_bookings, prepare_stays
from ..operators.stays import BADGES, group_members, mark_copies, note_badges, stay_checks, stay_classes, unit_moves
from ..settings import Settings, configure
from . import report as R
from .shared import cut, discard


ROSTER = ["stay_seq", "confirmation_number", "guest_name", "name_key", "unit", "unit_type", "arrival_date",
          "departure_date", "arrival", "departure", "guests_count", "mention_bound"]
BOOKING = ["booking_seq", "guest_name", "booking_name", "booking_day", "source_date", "booking_time", "party_size", "venue",
           "is_outside", "unit_hint", "notes_tags"]


@dataclass
class Reconciliation:
    """Lazy bundle: a part is planned, and shared tables are written, when first asked for."""

    raw_stays: DataFrame
    raw_bookings: DataFrame
    settings: Settings

    @cached_property
    def _roster(self) -> DataFrame:
        """The stays without their notes but with what these say of the stay; repeated records are marked by their `occurrences`."""
        stays = prepare_stays(self.raw_stays, self.settings).withColumns(note_badges()).select(*ROSTER, *BADGES)
        marked = mark_copies(stays) if self.settings.deduplicate else stays.withColumn("occurrences", F.lit(None).cast("bigint"))
        return cut(marked, "roster")

    @property
    def roster(self) -> DataFrame:
        """The first-seen stays without their notes: what everything but note mining works on."""
        return self._roster.where("occurrences IS NULL").drop("occurrences")

    @property
    def duplicates(self) -> DataFrame | None:
        return self._roster.where("occurrences IS NOT NULL") if self.settings.deduplicate else None

    @property
    def noted(self) -> DataFrame:
        """The first-seen stays with their notes."""
        stays = prepare_stays(self.raw_stays, self.settings)
        return stays if self.duplicates is None else stays.join(self.duplicates.select("stay_seq"), "stay_seq", "left_anti")

    @cached_property
    def bookings(self) -> DataFrame:
        return cut(prepare_bookings(self.raw_bookings, self.settings).select(*BOOKING), "bookings")

    @cached_property
    def mentions(self) -> DataFrame:
        return cut(note_mentions(self.noted, self.settings), "mentions")

    @cached_property
    def classes(self) -> DataFrame:
        return cut(stay_classes(self.roster), "stay_classes")

    @cached_property
    def groups(self) -> DataFrame:
        return group_members(self.roster, self.classes)

    @cached_property
    def moves(self) -> DataFrame:
        return unit_moves(self.roster)

    @cached_property
    def roster_checks(self) -> DataFrame:
        units = self.settings.units_table(self.raw_stays.sparkSession)
        return stay_checks(self.roster, units, self.settings)

    @cached_property
    def matching(self) -> M.Matching:
        return M.Matching(self.roster, self.bookings, lambda: self.mentions, self.settings, lambda: self.classes)

    @property
    def matches(self) -> DataFrame:
        """Every booking with its stay or the reason it has none."""
        return self.matching.matches

    @cached_property
    def _shared_matches(self) -> DataFrame:
        return cut(self.matching.matches, "matches")

    @property
    def unmatched(self) -> DataFrame:
        return M.unmatched(self.matches)

    @property
    def alternates(self) -> DataFrame:
        return M.alternates(self.roster, self.matching.candidates)

    def alternates_of(self, asked: DataFrame) -> DataFrame:
        """The alternates of every row of `asked` (booking_name, night, ...), with its columns."""
        return M.alternates(self.roster, self.matching.candidates, asked)

    @cached_property
    def mention_checks(self) -> DataFrame:
        return cut(C.mention_checks(self.mentions, self._shared_matches), "mention_checks")

    @property
    def note_checks(self) -> DataFrame:
        return C.note_checks(self._shared_matches, self.mention_checks)

    @property
    def _checked(self) -> DataFrame:
        return C.booking_checks(self._shared_matches, self.mention_checks)

    @property
    def lines(self) -> DataFrame:
        return self.lines_with(self.duplicates)

    def lines_with(self, duplicates: DataFrame | None) -> DataFrame:
        return R.report_lines(self.roster, self._checked, self.mention_checks, duplicates)

    @property
    def headers(self) -> DataFrame:
        return self.headers_with(self.duplicates)

    def headers_with(self, duplicates: DataFrame | None) -> DataFrame:
        return R.report_headers(self.roster, self._checked, self.mention_checks, self.groups, self.roster_checks, duplicates)

    @property
    def summary(self) -> DataFrame:
        worst = R.worst_by_stay(self._checked, self.mention_checks)
        heads = (self.roster.select("stay_seq").join(worst, "stay_seq", "left")
                 .select(F.coalesce("worst", F.lit(R.T.BLUE)).alias("severity")))
        if self.duplicates is not None:
            heads = heads.unionByName(self.duplicates.select(F.lit(R.T.RED).alias("severity")))
        return R.summary(heads, self.moves, self.groups)

    def write(self, path: str, fmt: str = "parquet", keep_other_months: bool = False) -> str:
        """Publish headers, lines and group members below `path`; `report.read_report` reads them."""
        tables = {"report_header": self.headers, "report_line": self.lines, "report_group": self.groups}
        return R.write_report(tables, self._dates, path, fmt, keep_other_months)

    def close(self) -> None:
        """Delete the tables of this session's runs; results not yet written are gone with them."""
        discard(self.raw_stays.sparkSession)

    @property
    def _dates(self) -> DataFrame:
        own = self.roster.select("stay_seq", "arrival")
        return own if self.duplicates is None else own.unionByName(self.duplicates.select("stay_seq", "arrival"))


def reconcile(stays: DataFrame, bookings: DataFrame, settings: Settings) -> Reconciliation:
    """Reconcile `stays` with `bookings`; see README for the columns of both."""
    configure(stays.sparkSession)
    return Reconciliation(stays, bookings, settings)
