"""Every operator as a query over the given tables: name -> callable(spark, sf_dir)."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stayledger import reconcile
from stayledger.functions import text as T
from stayledger.functions.notes import weekday_dates
from stayledger.operators import mentions as N
from stayledger.operators import stays as S
from stayledger.operators.hints import with_hinted_unit
from stayledger.operators.prepare import prepare_bookings, prepare_stays
from stayledger.plans import report as R
from stayledger.plans.flow import words_to_report
from stayledger.plans.incremental import History
from stayledger.plans.reconcile import Reconciliation
from stayledger.plans.shared import run_folder, writing
from stayledger.sources import words as W
from stayledger.sources.arrivals import parse_stays
from stayledger.sources.exports import parse_bookings

from . import derive, render

SETTINGS = derive.SETTINGS


def run(spark: SparkSession, sf_dir: str) -> Reconciliation:
    return reconcile(derive.stays(spark, sf_dir), derive.bookings(spark, sf_dir), SETTINGS)


def _joined(name: str, sep: str = ";") -> Column:
    return F.array_join(name, sep).alias(name)


def stay_fields(spark, sf_dir):
    k = F.col("name_key")
    return prepare_stays(derive.stays(spark, sf_dir), SETTINGS).select(
        "stay_seq", "arrival", "departure", T.nights(F.col("arrival"), F.col("departure")).alias("nights"),
        F.greatest(F.datediff("departure", "arrival"), F.lit(0)).alias("n_nights"),
        T.surname(k).alias("surname"), T.first_name(k).alias("first_name"),
        F.try_element_at(T.name_variants(k), F.lit(2)).alias("swapped_name"), T.group_surname(k).alias("group_surname"))


def booking_fields(spark, sf_dir):
    return prepare_bookings(derive.bookings(spark, sf_dir), SETTINGS).select(
        "booking_seq", "booking_day", T.clock(F.col("booking_time")).alias("booking_clock"), "venue", "is_outside",
        "unit_hint", _joined("flags"), T.is_bare(F.col("booking_name")).alias("bare"))


def inhouse_join(spark, sf_dir):
    r = run(spark, sf_dir)
    return S.inhouse_counts(r.classes, r.bookings)


def name_score(spark, sf_dir):
    return run(spark, sf_dir).matching.all_name_scores.select("booking_name", "stay_name", F.round("score", 6).alias("score"))


def match_bookings_query(spark, sf_dir):
    return run(spark, sf_dir).matches.select(
        "booking_seq", "match_method", "stay_seq", F.round("confidence", 6).alias("confidence"), _joined("flags"),
        "n_alternates", "group_id")


def unmatched_bookings(spark, sf_dir):
    return run(spark, sf_dir).unmatched


def match_alternates(spark, sf_dir):
    return run(spark, sf_dir).alternates.select(
        "booking_name", "night", "stay_seq", "guest_name", F.round("score", 6).alias("score"), "is_leader")


def match_siblings(spark, sf_dir):
    """The siblings of a match are the other rows of its group_id in `room_groups`."""
    return run(spark, sf_dir).matches.where("group_id IS NOT NULL").select(
        "booking_seq", "stay_seq", "group_id", (F.col("group_size") - 1).alias("n_siblings"))


def resolve_unit_hint(spark, sf_dir):
    bookings = prepare_bookings(derive.bookings(spark, sf_dir), SETTINGS).where("unit_hint IS NOT NULL")
    return with_hinted_unit(bookings, SETTINGS).select("booking_seq", "unit_hint", "hinted_unit")


def unit_lookup(spark, sf_dir):
    units = SETTINGS.units_table(spark)
    stays = derive.stays(spark, sf_dir).select("stay_seq", "unit")
    by_code = S.find_units(stays, units, code="unit").select("stay_seq", "unit", F.col("full_name").alias("by_code"))
    return S.find_units(by_code, units, name="unit").select("stay_seq", "by_code", F.col("abbreviation").alias("by_name"))


def room_groups(spark, sf_dir):
    return run(spark, sf_dir).groups


def room_moves(spark, sf_dir):
    return run(spark, sf_dir).moves.drop("earlier_n", "later_n")


def move_notes(spark, sf_dir):
    return S.move_notes(run(spark, sf_dir).roster)


def note_entries(spark, sf_dir):
    return N.note_entries(run(spark, sf_dir).noted, SETTINGS).select("stay_seq", "field_ord", "entry_ord", "entry")


def note_mentions(spark, sf_dir):
    dates = F.when(F.col("is_ambiguous"), weekday_dates(F.col("weekday"), F.col("arrival"), F.col("departure")))
    return N.note_mentions(run(spark, sf_dir).noted, SETTINGS).withColumn("candidate_dates", dates).select(
        "stay_seq", "source_field", "entry_ord", "date_ord", "venue", "resolved_date", "time_text", "weekday_text",
        "is_ambiguous", _joined("flags"), "raw_text",
        F.array_join(F.col("candidate_dates").cast("array<string>"), ",").alias("candidate_dates"))


def ambiguous_weekdays(spark, sf_dir):
    return run(spark, sf_dir).mention_checks.where("is_ambiguous OR weekday_settled").select(
        "stay_seq", "mention_ord", "venue", F.when(F.col("weekday_settled"), F.col("mention_date")).alias("settled_date"),
        "booking_seq", "status")


def note_cross_check(spark, sf_dir):
    return run(spark, sf_dir).note_checks.select(
        "stay_seq", "mention_ord", "source_field", "venue", "mention_date", "time_text", "booking_seq", "status", "mismatch_kind")


def _checks(spark, sf_dir):
    return run(spark, sf_dir).roster_checks


def capacity(spark, sf_dir):
    return _checks(spark, sf_dir).where("over_capacity_max IS NOT NULL").select(
        "stay_seq", F.col("over_capacity_guests").alias("actual_guests"), F.col("over_capacity_max").alias("max_guests"))


def bed_request(spark, sf_dir):
    return _checks(spark, sf_dir).where("bed_satisfied IS NOT NULL").select("stay_seq", F.col("bed_satisfied").alias("satisfied"))


def pet_policy(spark, sf_dir):
    return _checks(spark, sf_dir).where("pet_violation IS NOT NULL").select("stay_seq", F.col("pet_violation").alias("category"))


def perks(spark, sf_dir):
    return _checks(spark, sf_dir).where("consortium OR breakfast OR pet").select("stay_seq", "consortium", "breakfast", "pet")


def duplicates(spark, sf_dir):
    return run(spark, sf_dir).duplicates.select("stay_seq", "confirmation_number", "occurrences")


def report_lines(spark, sf_dir):
    return run(spark, sf_dir).lines.select(
        "stay_seq", "line_kind", "severity", _joined("reasons"), "booking_seq", "mention_ord", "detail")


def line_alternates(spark, sf_dir):
    r = run(spark, sf_dir)
    return R.line_alternates(r.lines, r.alternates_of).select("booking_seq", "stay_seq", "alternate_seq", "alternate_name", F.round("score", 6).alias("score"))


def words_to_report_query(spark, sf_dir):
    """The rendered documents, written as files and read as a folder, up to the headers."""
    words = (render.stay_words(spark, sf_dir).unionByName(render.booking_words(spark, sf_dir))
             .unionByName(render.document_words(spark, sf_dir)))
    folder = f"{run_folder(spark)}/words-{uuid.uuid4().hex}"
    with writing(spark):
        words.write.option("compression", "zstd").parquet(folder)
    return words_to_report(W.read_words(spark, folder), SETTINGS).headers.select(*HEADER)


def incremental_load(spark, sf_dir):
    """Documents a second run takes in, after a first one that saw the booking exports."""
    folder, ledger = (f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}" for name in ("words", "ledger"))
    render.booking_words(spark, sf_dir).write.parquet(folder)
    W.advance_ledger(W.read_words(spark, folder), ledger)
    render.stay_words(spark, sf_dir).write.mode("append").parquet(folder)
    changed = W.changed_documents(W.read_words(spark, folder), W.read_ledger(spark, ledger))
    return changed.groupBy("doc").agg(F.count(F.lit(1)).alias("n_words"), F.max("page").alias("pages"))


def incremental_report(spark, sf_dir):
    """Headers after three states of a folder: some documents missing, one cut short and one too many; then as they
    should be; then seen once more.  Records are named by document and place."""
    words = (render.stay_words(spark, sf_dir).unionByName(render.booking_words(spark, sf_dir)))
    late = F.crc32(F.col("doc").cast("binary")) % 5 == 0
    short, first = F.col("doc") == "arrivals-00000000", F.col("page") <= 2
    parts = F.when(short, F.array(F.lit("whole"), F.when(first, "short").otherwise("extra"))).otherwise(F.array(F.when(late, "late").otherwise("kept")))
    folder = f"{run_folder(spark)}/words-{uuid.uuid4().hex}"
    parted = words.where("doc IS NOT NULL").withColumn("part", F.explode(parts))
    parted = parted.withColumn("doc", F.when(F.col("part") == "extra", "arrivals-00000000b").otherwise(F.col("doc")))
    with writing(spark):
        parted.write.partitionBy("part").option("compression", "zstd").parquet(folder)  # the words are made once
    history = History(spark, f"{folder}/history", SETTINGS)
    for state in (["kept", "short", "extra"], ["kept", "late", "whole"], ["kept", "late", "whole"]):
        history.advance(W.read_words(spark, [f"{folder}/part={part}" for part in state]))
    docs = history.table("documents").select("doc", "label")
    heads = history.table("report_header").withColumn("label", F.shiftright("stay_seq", 32))
    first = docs.select(F.col("doc").alias("group_doc"), F.col("label").alias("group_label"))
    place = lambda seq: F.col(seq).bitwiseAND((1 << 32) - 1)
    return (heads.join(docs, "label").join(first, F.shiftright("group_id", 32) == F.col("group_label"), "left")
            .select("doc", place("stay_seq").alias("rec_no"), *[c for c in HEADER if c not in ("stay_seq", "group_id")],
                    F.concat_ws("/", "group_doc", place("group_id").cast("string")).alias("group_first")))


def written_report(spark, sf_dir):
    """Every value of a report that was written and read back, one text a row."""
    folder = f"{run_folder(spark)}/report-{uuid.uuid4().hex}"
    run(spark, sf_dir).write(folder)
    columns = {"report_header": HEADER, "report_group": GROUP,
               "report_line": ["stay_seq", "line_kind", "severity", "reasons", "booking_seq", "mention_ord", "detail"]}

    def shown(table: str) -> DataFrame:
        rows = R.read_report(spark, folder, table)
        cells = [F.array_join(c, ";") if t.startswith("array") else F.col(c).cast("string") for c, t in rows.select(*columns[table]).dtypes]
        text = F.concat_ws("|", *[F.coalesce(c, F.lit("-")) for c in cells])
        return rows.select(F.lit(table).alias("table_name"), "arrival_month", text.alias("row_text"))

    return shown("report_header").unionByName(shown("report_line")).unionByName(shown("report_group"))


def group_cells(spark, sf_dir):
    return R.group_cells(run(spark, sf_dir).groups, size=2)


GROUP = ["group_id", "matched_by", "group_size", "stay_seq", "unit", "guest_name"]
HEADER = ["stay_seq", "confirmation_number", "guest_name", "arrival", "severity", "n_lines", "consortium", "breakfast",
          "pet", "bed_requested", "bed_alert", "capacity_alert", "pet_alert", "move_note", "group_id", "matched_by",
          "group_size", "other_units", "is_duplicate", "occurrences"]


def report_headers(spark, sf_dir):
    return run(spark, sf_dir).headers.select(*HEADER)


def report_summary(spark, sf_dir):
    return run(spark, sf_dir).summary


def report_page(spark, sf_dir):
    """First, middle and last page by severity, the second by name and by arrival."""
    pages = R.Pages(R.select_headers(run(spark, sf_dir).headers, [T.RED, T.YELLOW], "an"))
    asked = [("severity", 1), ("severity", 7), ("severity", 1_000_000), ("name", 2), ("arrival", 2)]
    shown = [pages.page(n, by).select(F.lit(by).alias("sorted_by"), F.lit(n).alias("page"), "stay_seq", "guest_name", "severity") for by, n in asked]
    return reduce(DataFrame.unionByName, shown)


def note_profile(spark, sf_dir):
    return R.note_profile(prepare_stays(derive.stays(spark, sf_dir), SETTINGS)).drop("flags")


def display_fields(spark, sf_dir):
    return R.display_fields(prepare_bookings(derive.bookings(spark, sf_dir), SETTINGS), SETTINGS)


def classify_docs(spark, sf_dir):
    words = (render.stay_words(spark, sf_dir).unionByName(render.booking_words(spark, sf_dir))
             .unionByName(render.document_words(spark, sf_dir)))
    return W.classify_documents(words, SETTINGS)


def lines(spark, sf_dir):
    return W.printed_lines(render.stay_words(spark, sf_dir)).select("doc", "page", "line_no", W.text_in().alias("text"))


def parse_stays_query(spark, sf_dir):
    return parse_stays(render.stay_words(spark, sf_dir), SETTINGS).select(
        "doc", "rec_no", "source_page", "confirmation_number", "guest_name", "unit", "unit_type", "status", "arrival_date",
        "departure_date", "guests_count", "guests_share", "rate_plan", "guest_notes", "reservation_notes",
        "comments_notes", "address", "last_stay_property", "lifetime_nights", "lifetime_stays", "booking_agency", "iata", _joined("flags"))


def parse_bookings_query(spark, sf_dir):
    return parse_bookings(render.booking_words(spark, sf_dir), SETTINGS).select(
        "doc", "rec_no", "source_date", "booking_time", "party_size", "guest_name", "phone", "notes_tags", "venue",
        "unit_hint", "is_outside", _joined("flags"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__.removesuffix("_query"): f for f in (
        stay_fields, booking_fields, inhouse_join, name_score, match_bookings_query, unmatched_bookings,
        match_alternates, match_siblings, resolve_unit_hint, unit_lookup, room_groups, room_moves, move_notes,
        note_entries, note_mentions, ambiguous_weekdays, note_cross_check, capacity, bed_request, pet_policy,
        perks, duplicates, report_lines, line_alternates, group_cells, words_to_report_query, incremental_load, incremental_report, written_report, report_headers, report_summary, report_page, note_profile,
        display_fields, classify_docs, lines, parse_stays_query, parse_bookings_query)}
