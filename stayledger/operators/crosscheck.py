"""Compare what the notes of a stay say with the bookings matched to it.

The assignment is greedy in note order and uses a booking once, so it is sequential
within a stay - but only as many bookings as the stay has mentions can ever be used.  In
each (day, venue) the first `mention_bound` bookings therefore decide the outcome; the
others are "not in the notes" whatever happens.  These are a queue: of equal day and venue the
first is always taken first, so the fold's state is the heads of a stay's queues, and a mention
looks at heads, not at bookings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T

# Slices a hot (stay, day, venue) is spread over before its first bookings are taken.
SLICES = 32


def deciding_bookings(matches: DataFrame) -> DataFrame:
    """Per stay the bookings that can be assigned to a mention, as queues by day and venue."""
    place = ["stay_seq", "booking_day", "venue"]
    first = lambda *more: F.row_number().over(Window.partitionBy(*place, *more).orderBy("booking_seq"))
    return (matches.where("stay_seq IS NOT NULL AND mention_bound > 0")
            .select("stay_seq", "booking_seq", "booking_day", "venue", "booking_clock", "mention_bound",
                    F.pmod(F.xxhash64("booking_seq"), F.lit(SLICES)).alias("slice"))
            .withColumn("nth", first("slice")).where("nth <= mention_bound")
            .withColumn("nth", first()).where("nth <= mention_bound")
            .groupBy("stay_seq", F.col("booking_day").alias("day"), "venue")
            .agg(F.array_sort(F.collect_list(F.struct("booking_seq", F.col("booking_clock").alias("clock")))).alias("line"))
            .groupBy("stay_seq").agg(F.collect_list(F.struct("day", "venue", "line")).alias("queues")))


def _settle_weekday(m: Column, queues: Column) -> Column:
    """An ambiguous weekday means the one day on which the stay has a booking there."""
    days = F.array_distinct(F.transform(
        F.filter(queues, lambda q: (q["venue"] == m["venue"]) & (F.weekday(q["day"]) == m["weekday"])),
        lambda q: q["day"]))
    return F.when(m["is_ambiguous"] & (F.size(days) == 1), F.element_at(days, 1))


TAKEN = "array<struct<booking_seq:bigint,day:date,venue:string,clock:int>>"
QUEUES = "array<struct<day:date,venue:string,line:array<struct<booking_seq:bigint,clock:int>>>>"

#: N5 for one mention: of the queues' heads, the first of the best kind.  0: that day and venue, 1: that day, another
#: venue, 2: that venue, another day.
PICK = """array_min(filter(transform(queues, (q, i) -> named_struct(
    'kind', if(q.day = m.day, if(coalesce(q.venue = m.venue, false), 0, 1), if(q.venue = m.venue, 2, NULL)),
    'seq', try_element_at(q.line, element_at(s.heads, i + 1)).booking_seq, 'queue', i)),
  x -> x.kind IS NOT NULL AND x.seq IS NOT NULL AND m.day IS NOT NULL))"""
ASSIGNED = f"""aggregate(said, named_struct('heads', transform(queues, q -> 1), 'taken', CAST(array() AS {TAKEN})),
  (s, m) -> transform(array({PICK}), p -> named_struct(
    'heads', if(p IS NULL, s.heads, transform(s.heads, (h, i) -> if(i = p.queue, h + 1, h))),
    'taken', concat(s.taken, array(if(p IS NULL, NULL, transform(array(element_at(queues, p.queue + 1)), q -> named_struct(
      'booking_seq', p.seq, 'day', q.day, 'venue', q.venue, 'clock', element_at(q.line, element_at(s.heads, p.queue + 1)).clock))[0])))))[0],
  s -> s.taken)"""


def mention_checks(mentions: DataFrame, matches: DataFrame) -> DataFrame:
    """One row per mention with the booking it takes, if any."""
    per_stay = mentions.groupBy("stay_seq").agg(F.array_sort(F.collect_list(F.struct(
        "field_ord", "entry_ord", "date_ord", "venue", "resolved_date", "is_ambiguous", "weekday",
        "source_field", "raw_text", "time_text"))).alias("said"))
    j = per_stay.join(deciding_bookings(matches), "stay_seq", "left")
    j = j.withColumn("queues", F.coalesce("queues", F.array().cast(QUEUES)))
    said = F.transform("said", lambda m: m.withField("settled_date", _settle_weekday(m, F.col("queues"))))
    j = j.withColumn("said", F.transform(said, lambda m: m.withField(
        "day", F.coalesce(m["resolved_date"], m["settled_date"]))))
    # Without bookings nothing is taken; zipping fills up with nulls.
    j = j.withColumn("taken", F.when(F.size("queues") > 0, F.expr(ASSIGNED)).otherwise(F.array().cast(TAKEN)))
    rows = (j.select("stay_seq", F.posexplode(F.arrays_zip("said", "taken")).alias("mention_ord", "x"))
            .select("stay_seq", "mention_ord", "x.said.*", F.col("x.taken").alias("b")))
    hit = F.col("b").isNotNull()
    exact = (F.col("b.day") == F.col("day")) & F.coalesce(F.col("b.venue") == F.col("venue"), F.lit(False))
    late = F.col("time_text").isNotNull() & ~F.coalesce(
        T.clock(F.col("time_text")) == F.col("b.clock"), F.lit(False))
    return rows.select(
        "stay_seq", "mention_ord", "source_field", "venue", F.col("day").alias("mention_date"),
        "time_text", "raw_text", (F.col("is_ambiguous") & F.col("settled_date").isNull()).alias("is_ambiguous"),
        (F.col("settled_date").isNotNull()).alias("weekday_settled"),
        F.col("b.booking_seq").alias("booking_seq"),
        F.when(~hit, "note_without_reservation").when(~exact, "mismatch")
        .when(late, "time_mismatch").otherwise("matched").alias("status"),
        F.when(hit & exact & late, "time")
        .when(hit & ~exact, F.when(F.col("b.day") == F.col("day"), "venue").otherwise("date"))
        .alias("mismatch_kind"))


def booking_checks(matches: DataFrame, checks: DataFrame) -> DataFrame:
    """Every matched booking with its check; those no mention took are N9."""
    taken = checks.where("booking_seq IS NOT NULL").select(
        "booking_seq", "mention_ord", "mention_date", "time_text", "raw_text", "source_field",
        F.col("venue").alias("mention_venue"), "status", "mismatch_kind")
    return (matches.where("stay_seq IS NOT NULL").join(taken, "booking_seq", "left")
            .withColumn("status", F.coalesce("status", F.lit("reservation_without_note"))))


def note_checks(matches: DataFrame, checks: DataFrame) -> DataFrame:
    """All cross-check results: mentions first, then bookings missing in the notes."""
    missing = (matches.where("stay_seq IS NOT NULL")
               .join(checks.where("booking_seq IS NOT NULL").select("booking_seq"), "booking_seq", "left_anti")
               .select("stay_seq", "booking_seq", F.lit("reservation_without_note").alias("status")))
    return checks.unionByName(missing, allowMissingColumns=True)
