"""Configuration of a run: everything the operators must not hard-code.

Venues are folded into expressions and therefore are values; units and spellings are
rows, given as values or as tables of any size, and reach the data by joins.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# --- Fixed values of the input formats and of the matching rules ---------------------

NOTE_FIELDS = ("guest_notes", "reservation_notes", "comments_notes")

OUTSIDE_PHRASES = ("off property", "og", "outside guest")
KNOWN_STATUSES = ("Reserved",)

ACCEPT_SCORE = 72
AMBIGUITY_MARGIN = 8
COMPONENT_SCORE = 85

MONTHS = ("january", "february", "march", "april", "may", "june", "july",
          "august", "september", "october", "november", "december")
WEEKDAYS = ("MONDAY", "TUESDAY", "WEDNESDAY", "THURSDAY", "FRIDAY", "SATURDAY", "SUNDAY")

# Arrivals report: printed label -> field
LABELS = {
    "VIP Level": "vip_level",
    "Address": "address",
    "Preferences": "preferences",
    "Last Stay Property": "last_stay_property",
    "Last Checkout Date": "last_checkout_date",
    "Booking Agency": "booking_agency",
    "Guest Notes": "guest_notes",
    "Reservation Notes": "reservation_notes",
    "Comments / Notes": "comments_notes",
}
INLINE_LABELS = {
    "Lifetime Revenue:": "lifetime_revenue",
    "Lifetime Stays:": "lifetime_stays",
    "Lifetime Nights:": "lifetime_nights",
    "IATA:": "iata",
}
CONTINUATION_FIELDS = ("guest_notes", "reservation_notes", "comments_notes",
                       "preferences", "address")

LINE_TOLERANCE = 2.0


#: Venue words a configuration may have: each is part of every expression that looks for venues.
MOST_VENUES = 1_000


@dataclass(frozen=True)
class Unit:
    abbreviation: str | None
    full_name: str
    category: str
    unit_type_code: str | None = None
    max_guests: int | None = None
    has_sofa_bed: bool = False


@dataclass(frozen=True)
class ArrivalsLayout:
    """Where the arrivals report prints its columns (x0 ranges) and what is furniture."""

    marker: str = "Arrivals with Details"
    unit: tuple[float, float] = (0, 100)
    name: tuple[float, float] = (100, 235)
    status: tuple[float, float] = (235, 330)
    date: tuple[float, float] = (325, 430)
    party: tuple[float, float] = (435, 460)
    rate: tuple[float, float] = (490, 574)
    label_boundary: float = 160.0
    labels: tuple[tuple[str, str], ...] = tuple(LABELS.items())
    inline_labels: tuple[tuple[str, str], ...] = tuple(INLINE_LABELS.items())
    continued: tuple[str, ...] = CONTINUATION_FIELDS
    # Fields whose value holds inline labels, and an agency with its number after a mark.
    inline_field: str = "last_stay_property"
    agency_fields: tuple[str, str] = ("booking_agency", "iata")
    agency_mark: str = "IATA:"
    # Words that mark a line as a repetition of the stay dates.
    dates_line: tuple[str, ...] = ("Stay", "Date")
    furniture_prefixes: tuple[str, ...] = (
        "Arrivals with Details", "PROPERTY:", "USER:", "Room Guest Name",
        "Room Type Confirmation", "Stay Date (Days)", "Room Type Rate Plan Rate")
    range_line: tuple[str, str] = ("Between", "and")
    total_label: str = "Total Reservations"
    # Owner's name printed after the time stamp in the page head; "" accepts any owner.
    stamp_owner: str = ""


@dataclass(frozen=True)
class BookingsLayout:
    """Where the booking export prints its columns and what is furniture.

    ``vendor_phrases`` are footer texts naming the vendor of the booking system; they
    belong to a site's configuration, like its venues.
    """

    markers: tuple[str, ...] = ("Booking Export",)
    time: tuple[float, float] = (40, 95)
    party: tuple[float, float] = (100, 145)
    name: tuple[float, float] = (170, 270)
    notes: tuple[float, float] = (275, 355)
    filter_bar: tuple[float, float] = (60, 350)
    head_top: float = 60.0
    # Furniture: how lines begin, what they contain, what they are, and the words of a day bar.
    line_starts: tuple[str, ...] = ("Time Party", "Notes & Tags")
    line_parts: tuple[str, ...] = ("Guest Details", "Total Covers")
    whole_lines: tuple[str, ...] = ("Tags",)
    day_words: tuple[str, ...] = ("Today", "Future Day", "Yesterday")
    footer_phrases: tuple[str, ...] = (
        "About", "Discover", "Languages", "Content Guidelines", "Accessibility Statement",
        "Business Resource Center", "Terms of Service", "Privacy Policy",
        "Carrier rates may apply", "Ad Choices", "Trust & Safety", "Manage Cookies",
        "Support", "Copyright", "Need Help?", "Send link", "Enter your number",
        "download the app")
    vendor_phrases: tuple[str, ...] = ()

    @property
    def footer(self) -> tuple[str, ...]:
        return self.footer_phrases + self.vendor_phrases


@dataclass(frozen=True)
class Settings:
    """Venues (keyword, name) in priority order, units, spellings and thresholds."""

    venues: tuple[tuple[str, str], ...]
    units: tuple[Unit, ...] = ()
    misspellings: tuple[tuple[str, str], ...] = ()
    outside_phrases: tuple[str, ...] = OUTSIDE_PHRASES
    outside_whole_word: bool = False
    # A site's own shorthand in tags, words that are never units, and where pets may stay.
    shorthand: tuple[str, ...] = ()
    non_unit_terms: tuple[str, ...] = ()
    known_statuses: tuple[str, ...] = KNOWN_STATUSES
    pet_category: str | None = None
    accept_score: int = ACCEPT_SCORE
    ambiguity_margin: int = AMBIGUITY_MARGIN
    component_score: int = COMPONENT_SCORE
    deduplicate: bool = True
    arrivals: ArrivalsLayout = field(default_factory=ArrivalsLayout)
    bookings: BookingsLayout = field(default_factory=BookingsLayout)
    unit_rows: DataFrame | None = field(default=None, compare=False)
    spelling_rows: DataFrame | None = field(default=None, compare=False)

    def with_(self, **changes) -> "Settings":
        return replace(self, **changes)

    def units_table(self, spark: SparkSession) -> DataFrame:
        """The directory, one row per abbreviation (and all units without one): of a list the first, of a table the least."""
        if self.unit_rows is not None:
            return one_row_each(self.unit_rows.where("abbreviation IS NOT NULL"), F.col("abbreviation")).unionByName(
                self.unit_rows.where("abbreviation IS NULL"))
        rows, seen = [], set()
        for u in self.units:
            if u.abbreviation is None or u.abbreviation not in seen:
                rows.append(asdict(u))
                seen.add(u.abbreviation)
        schema = ("array<struct<abbreviation:string,full_name:string,category:string,"
                  "unit_type_code:string,max_guests:int,has_sofa_bed:boolean>>")
        return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), schema)))

    def aliases(self, spark: SparkSession) -> DataFrame:
        """(token, unit): a misspelling wins over an abbreviation, that over a full name;
        blocked terms name nothing."""
        units = self.units_table(spark)
        coded = units.where("abbreviation IS NOT NULL").select(F.col("abbreviation").alias("unit"))
        spelled = self.spelling_rows
        if spelled is None:
            spelled = spark.range(1).select(F.inline(F.from_json(
                F.lit(json.dumps([{"token": t, "abbreviation": c} for t, c in self.misspellings])),
                "array<struct<token:string,abbreviation:string>>")))
        letters = F.upper(F.regexp_replace("full_name", "[^A-Za-z]", ""))
        named = (spelled.join(coded, F.col("abbreviation") == F.col("unit")).select("token", "unit", F.lit(0).alias("prio"))
                 .unionByName(coded.select(F.col("unit").alias("token"), "unit", F.lit(1).alias("prio")))
                 .unionByName(units.select(letters.alias("token"), F.coalesce("abbreviation", "full_name").alias("unit"), F.lit(2).alias("prio"))))
        return (named.where((F.col("token") != "") & ~F.col("token").isin(*self.non_unit_terms))
                .groupBy("token").agg(F.min_by("unit", F.struct("prio", "unit")).alias("unit")))

    @classmethod
    def from_tables(cls, venues: DataFrame, units: DataFrame | None = None,
                    misspellings: DataFrame | None = None, **rest) -> "Settings":
        """Settings from tables: venues(prio, keyword, venue), units(...),
        misspellings(token, abbreviation).  Only venues, which become part of the
        expressions, are read here, MOST_VENUES at most; units and misspellings stay tables."""
        vs = sorted(venues.limit(MOST_VENUES + 1).collect(), key=lambda r: (r["prio"], r["keyword"]))
        if len(vs) > MOST_VENUES:
            raise ValueError(f"more than {MOST_VENUES} venue words")
        return cls(venues=tuple((r["keyword"], r["venue"]) for r in vs), unit_rows=units,
                   spelling_rows=misspellings, **rest)


def one_row_each(rows: DataFrame, key: Column) -> DataFrame:
    """The least of the rows of every key, in all columns, so that reruns agree."""
    least = F.min(F.struct(*rows.columns)).alias("row")
    return rows.groupBy(key.alias("_key")).agg(least).select("row.*")


# Session settings the plans count on. AQE's skew join splits a hot join key even when
# that costs an extra shuffle; every aggregation combines on the map side anyway.
SESSION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Rows that are sorted by their group are folded in that order, without a table of groups.
    "spark.sql.execution.replaceHashWithSortAgg": "true",
    # The JVM never compiles a method of more bytecode than this.  Steps that would be one such method (parsing
    # of notes, the roster) run as several smaller ones.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SESSION_CONF.items():
        spark.conf.set(key, value)
    return spark
