"""Properties that keep the plans sound when one key is hot."""

import glob
import os
import random
import time

import pytest
from build import SETTINGS, Case
from pyspark.sql import functions as F

from stayledger import reconcile
from stayledger.plans.reconcile import Reconciliation
from stayledger.plans.report import read_report
from stayledger.plans.shared import cut, once, run_folder


def greedy(mentions, bookings):
    """Plain reading of the assignment rule."""
    used, out = set(), []
    for venue, day in mentions:
        free = [b for b in bookings if b[0] not in used]
        pick = next((b for b in free if b[1] == venue and b[2] == day), None) \
            or next((b for b in free if b[1] != venue and b[2] == day), None) \
            or next((b for b in free if b[1] == venue), None)
        if pick:
            used.add(pick[0])
        out.append(pick[0] if pick else None)
    return out


@pytest.fixture(scope="module")
def hot(spark):
    """One stay with most of the bookings, several mentions, and many namesakes."""
    rng = random.Random(11)
    c = Case()
    said = [("Lantern", 3), ("Quarry", 3), ("Lantern", 3), ("Quarry", 5), ("Lantern", 9), ("Quarry", 3)]
    c.stay("hot", "Mora, Eva", "07/01/2026", "07/08/2026",
           comments=", ".join(f"{v} 7/{d} @ 7PM" for v, d in said))
    for i in range(90):
        c.stay(f"same {i}", "Nash, Eva", "07/01/2026", "07/08/2026")
    booked = []
    for i in range(300):
        venue, day = rng.choice(["lantern", "quarry", "no"]), rng.choice([2, 4, 5, 6] if i < 200 else [2, 3])
        c.book(i, "Eva Mora", f"Jul {day}, 2026", tags=f"{venue} ALDER")
        booked.append((i, {"lantern": "Lantern", "quarry": "Quarry"}.get(venue), day))
    for i in range(40):
        c.book(1000 + i, "NASH", "Jul 3, 2026", tags="lantern")
    return c, said, booked, reconcile(*c.frames(spark), SETTINGS)


def test_greedy_over_many_bookings(hot):
    c, said, booked, r = hot
    rows = sorted((x for x in r.mention_checks.collect() if x.stay_seq == 0), key=lambda x: x.mention_ord)
    assert [x.booking_seq for x in rows] == greedy(said, booked)
    n = r.note_checks.where("status = 'reservation_without_note' AND stay_seq = 0").count()
    assert n == len(booked) - sum(x.booking_seq is not None for x in rows)


def test_greedy_over_many_mentions(spark):
    """Hundreds of mentions and thousands of bookings of one stay, taken from queues."""
    import datetime as dt

    from stayledger.operators.crosscheck import mention_checks
    rng = random.Random(4)
    day = lambda: dt.date(2026, 7, rng.randint(1, 6))
    venues = ["Lantern", "Quarry", None]
    said = [(rng.choice(venues[:2]), day()) for _ in range(300)]
    booked = [(i, rng.choice(venues), day()) for i in range(3000)]
    mentions = spark.createDataFrame(
        [(1, 0, n, 0, v, d, False, None, "guest_notes", "x", None) for n, (v, d) in enumerate(said)],
        "stay_seq bigint, field_ord int, entry_ord int, date_ord int, venue string, resolved_date date, is_ambiguous boolean, weekday int, "
        "source_field string, raw_text string, time_text string")
    matches = spark.createDataFrame([(1, i, d, v, 1900, 300) for i, v, d in booked],
                                    "stay_seq bigint, booking_seq bigint, booking_day date, venue string, booking_clock int, mention_bound int")
    rows = sorted(mention_checks(mentions, matches).collect(), key=lambda x: x.mention_ord)
    assert [x.booking_seq for x in rows] == greedy(said, booked)


def test_namesakes_are_counted_not_paired(hot):
    c, _, _, r = hot
    assert r.matching.candidates.where("booking_name = 'nash'").count() == 0  # one group: no ambiguity
    sets = r.matching.sets.where("booking_name = 'nash'").collect()
    assert len(sets) == 1 and sets[0].leader_seq == c.stay_no["same 0"] and sets[0].group_size == 90
    assert r.matches.where("booking_name = 'nash' AND group_size = 90").count() == 40


def test_no_pairwise_joins_in_plans(hot):
    r: Reconciliation = hot[3]
    for df in (r.matches, r.note_checks, r.lines, r.headers, r.groups, r.moves, r.alternates, r.duplicates):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_shared_folder_is_the_sessions(spark, hot):
    from stayledger.plans.shared import run_folder
    assert run_folder(spark).startswith(spark.conf.get("spark.checkpoint.dir"))


def test_large_groups_are_whole(hot):
    c, _, _, r = hot
    heads = [h for h in r.headers.collect() if h.stay_seq in {c.stay_no[f"same {i}"] for i in range(90)}]
    assert len(heads) == 90 and all(h.group_size == 90 and h.other_units == 89 for h in heads)
    assert r.groups.where("group_size = 90").count() == 90


def test_accented_venue_in_the_other_case(spark):
    c = Case()
    c.stay("guest", "Amaro, Zora", "05/20/2031", "05/23/2031", comments="BRÛLERIE 5/21 @ 6PM")
    c.book("table", "Zora Amaro", "May 21, 2031", "6:00", tags="brûlerie ALDER")
    r = reconcile(*c.frames(spark), SETTINGS.with_(venues=(("brûlerie", "Brûlerie"),)))
    assert [x.status for x in r.note_checks.collect()] == ["matched"]
    assert r.matches.first().hinted_unit == "ALDER"


def test_candidates_per_true_pair_stay_flat(spark):
    """However many names are there at one time, few strings are looked at per pair that is alike, also at 72."""
    from pyspark.sql import functions as F

    from stayledger.functions.similarity import candidate_pairs, similar_pairs
    rng = random.Random(2)
    names = sorted({"".join(rng.choice("abdeiklmnorstu") for _ in range(rng.randint(4, 9))) for _ in range(3000)})
    rng.shuffle(names)
    for score in (72, 85):
        share = []
        for n in (300, 600, 1200, 2400):
            rows = spark.createDataFrame([("surname", name) for name in names[:n]], "kind string, a string")
            other = rows.withColumnRenamed("a", "b")
            looked_at = candidate_pairs(rows, other, score).where(F.col("a") != F.col("b")).count()
            share.append(looked_at / max(1, similar_pairs(rows, other, score).where(F.col("a") != F.col("b")).count()))
        assert share[3] < 1.5 * max(share[0], 1) and share[3] < (1.2 if score == 85 else 12), share


def test_names_meet_only_in_common_blocks(spark):
    from stayledger.functions.similarity import candidate_pairs
    left = spark.createDataFrame([("n", "maren", [1, 2]), ("n", "marin", [3])], "kind string, a string, blocks array<int>")
    right = spark.createDataFrame([("n", "maren", [2, 3]), ("n", "maran", [1])], "kind string, b string, blocks array<int>")
    got = {(r.a, r.b) for r in candidate_pairs(left, right, 72, within="blocks").collect()}
    assert got == {("maren", "maren"), ("maren", "maran"), ("marin", "maren")}


@pytest.fixture(scope="module")
def spells(spark):
    """Namesakes and near names over years, some of stays that never share a night."""
    rng = random.Random(8)
    c, nights = Case(), set()
    import datetime as dt
    names = [("Okafor", "Maren"), ("Okafort", "Maren"), ("Lindqvist", "Ilse"), ("Lindquist", "Ilse"), ("Quill", "Zora"), ("Quills", "T.K."), ("Moreau", "")]
    for i in range(60):
        last, first = rng.choice(names)
        a = dt.date(2026, 1, 1) + dt.timedelta(rng.randrange(2500))
        length = rng.choice([1, 2, 3, 70, 400])
        c.stay(i, f"{last}, {first}" if first else last, a.strftime("%m/%d/%Y"), (a + dt.timedelta(length)).strftime("%m/%d/%Y"), conf=f"K{i}")
        nights.add((f"{last}, {first}" if first else last, a, length))
    booked = []
    for i in range(80):
        last, first = rng.choice(names)
        day = dt.date(2026, 1, 1) + dt.timedelta(rng.randrange(2500))
        name = rng.choice([last.upper(), f"{first} {last}".strip(), f"{last}, {first}"])
        c.book(i, name, day.strftime("%b %-d, %Y"))
        booked.append((name, day))
    return c, nights, booked


@pytest.mark.parametrize("days,words", [(7, 1), (56, 2), (50, 200)])
def test_scored_pairs_share_a_night_whatever_the_block(spark, spells, monkeypatch, days, words):
    import datetime as dt

    from stayledger.operators import names as N
    from stayledger.operators.matching import present_spans
    c, nights, booked = spells
    r = reconcile(*c.frames(spark), SETTINGS)
    monkeypatch.setattr(N, "WORD_DAYS", days)
    got = {(x.booking_name, x.stay_name) for x in N.score_names(*present_spans(r.roster, r.matching.wanted), SETTINGS, words).collect()}
    together = {(b.lower().strip(), s.lower().strip()) for b, day in booked for s, a, n in nights if a <= day < a + dt.timedelta(n)}
    monkeypatch.setattr(N, "WORD_DAYS", 64)
    every = reconcile(*_all_at_once(c).frames(spark), SETTINGS).matching.name_scores.collect()
    assert got == together & {(x.booking_name, x.stay_name) for x in every} and got


def test_all_names_are_scored_whenever_they_are_there(spark, spells):
    """The table of scores does not leave out names that never share a night."""
    c = spells[0]
    rows = lambda df: {(x.booking_name, x.stay_name, round(x.score, 6)) for x in df.collect()}
    m = reconcile(*c.frames(spark), SETTINGS).matching
    every = rows(reconcile(*_all_at_once(c).frames(spark), SETTINGS).matching.name_scores)
    assert rows(m.all_name_scores) == every and rows(m.name_scores) < every


def _all_at_once(c):
    """The same names, all there on one day."""
    out = Case()
    for i, (_, _, name, *_) in enumerate(c.stays):
        out.stay(i, name, "07/01/2026", "07/03/2026", conf=f"K{i}")
    for i, (_, _, _, _, name, _) in enumerate(c.bookings):
        out.book(i, name, "Jul 1, 2026")
    return out


def test_in_house_counts_do_not_spell_out_nights(spark, spells):
    import datetime as dt

    from pyspark.sql import functions as F

    from stayledger.operators.stays import cover, inhouse_counts
    c, nights, booked = spells
    r = reconcile(*c.frames(spark), SETTINGS)
    got = {x.booking_seq: (x.in_house, x.first_stay) for x in inhouse_counts(r.classes, r.bookings).collect()}
    day = lambda t: dt.datetime.strptime(t, "%m/%d/%Y").date()
    spans = [(s[0], day(s[6]), day(s[7])) for s in c.stays]
    for i, (_, d) in enumerate(booked):
        inside = [seq for seq, a, e in spans if a <= d < e]
        assert got.get(i) == ((len(inside), min(inside)) if inside else None)
    rows = spark.sql("SELECT DATE'2026-01-05' AS a, date_add(DATE'2026-01-04', n) AS b, n FROM VALUES (1), (10), (3000), (900000) t(n)").select("n", cover("a", "b").alias("nodes"))
    sizes = {x.n: x.nodes for x in rows.collect()}
    assert len(sizes[1]) == 1 and len(sizes[10]) <= 8 and len(sizes[3000]) <= 24 and len(sizes[900000]) <= 40
    for n, nodes in list(sizes.items())[:3]:
        days = sorted(d for x in nodes for d in range((x >> 6) << (x & 63), ((x >> 6) + 1) << (x & 63)))
        first = (dt.date(2026, 1, 5) - dt.date(1970, 1, 1)).days
        assert days == list(range(first, first + n))


def written(spark):
    import os

    from stayledger.plans.shared import run_folder
    folder = run_folder(spark)
    return len(os.listdir(folder)) if os.path.isdir(folder) else 0


@pytest.mark.parametrize("ask,most", [(lambda r: r.matching.name_scores, 6), (lambda r: r.groups, 2), (lambda r: r.moves, 1)])
def test_only_needed_tables_are_written(spark, ask, most):
    c = Case()
    c.stay("a", "Amaro, Zora", "05/20/2031", "05/23/2031", comments="Lantern 5/21")
    c.book("b", "Zora Amaro", "May 21, 2031")
    before = written(spark)
    ask(reconcile(*c.frames(spark), SETTINGS)).collect()
    assert 0 < written(spark) - before <= most


def test_alternates_meet_by_equality(spark):
    """Nights and stays of a name are joined by equal nodes: no pair is made that is not a row, and the rows are those of the rule."""
    import datetime as dt

    from stayledger.operators.matching import alternates
    rng = random.Random(8)
    day = lambda n: dt.date(2026, 1, 1) + dt.timedelta(days=n)
    stays = [(i, "mora, eva", "Mora, Eva", day(a), None if i % 9 == 0 else day(a + rng.choice([0, 1, 3, 12, 400])))
             for i, a in enumerate(rng.choices(range(60), k=80))] + [(900, "mora, eva", "Mora, Eva", None, day(9)), (901, "other", "Other", day(1), day(50))]
    sets = [("eva mora", day(n), "mora, eva", 100.0, 3) for n in (0, 5, 17, 40, 41, 70, 300)]
    got = alternates(spark.createDataFrame(stays, "stay_seq bigint, name_key string, guest_name string, arrival date, departure date"),
                     spark.createDataFrame(sets, "booking_name string, night date, stay_name string, score double, leader_seq bigint"))
    rows = sorted((r.night, r.stay_seq, r.is_leader) for r in got.collect())
    assert rows == sorted((n, s, s == 3) for _, n, name, _, _ in sets for s, key, _, a, d in stays if key == name and a and d and a <= n < d)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "node" in plan and "(night#" not in plan.split("Join Inner")[0]


def test_long_methods_are_split(hot):
    """A step of more bytecode than the JVM compiles runs as several methods."""
    assert int(hot[3].raw_stays.sparkSession.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_mentions_without_bookings_take_nothing(spark):
    c = Case()
    c.stay("alone", "Amaro, Zora", "05/20/2031", "05/23/2031", comments="Lantern 5/21 @ 6PM, Quarry 5/22")
    c.book("other", "Wim Quill", "May 21, 2031", "6:00")
    r = reconcile(*c.frames(spark), SETTINGS)
    assert [(x.status, x.booking_seq) for x in r.mention_checks.orderBy("mention_ord").collect()] == [("note_without_reservation", None)] * 2


def shuffle_files(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in dirs for f in glob.glob(f"{d}/*/shuffle_*.data")}


def test_written_tables_leave_no_shuffle_files(spark):
    before = shuffle_files(spark)
    written = cut(spark.range(50_000).repartition(4, "id").groupBy((F.col("id") % 7_000).alias("k")).count(), "kept")
    until = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left and written.count() == 7_000


def test_tables_on_the_way_are_deleted(spark):
    folder = run_folder(spark)
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    inside = []

    def make():
        inside.append(cut(spark.range(10), "way_a"))
        return cut(once(lambda: cut(inside[0].withColumn("b", F.col("id") * 2), "way_b"), "way_c").where("id > 3"), "way_d")

    out = once(make, "way_out")
    assert out.count() == 6
    assert {n.split("-")[0] for n in set(os.listdir(folder)) - before} == {"way_out"}


def test_alternates_of_lines_are_not_shuffled(spark):
    """The join of names with stays by nodes is the last: no list of alternates travels to the lines.  Rows are those of the lists."""
    from stayledger.plans.report import line_alternates
    rng = random.Random(21)
    c = Case()
    for i in range(60):
        a = rng.randint(1, 20)
        c.stay(i, rng.choice(["Nash, Eva", "Nash, Ida", "Mora, Eva"]), f"07/{a:02}/2026", f"07/{a + rng.choice([1, 2, 7]):02}/2026")
    for i in range(80):
        c.book(i, rng.choice(["Nash", "Eva Nash", "Eva Mora"]), f"Jul {rng.randint(1, 24)}, 2026")
    r = reconcile(*c.frames(spark), SETTINGS)
    found = line_alternates(r.lines, r.alternates_of)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "node" in next(x for x in plan.splitlines() if "Join" in x)
    lists = {}
    for x in r.alternates.collect():
        lists.setdefault((x.booking_name, x.night), []).append((x.stay_seq, x.guest_name, x.score))
    asked = [x for x in r.lines.collect() if {"ambiguous", "resolved_by_note"} & set(x.reasons)]
    want = sorted((x.booking_seq, x.stay_seq, *other) for x in asked for other in lists[x.set_name, x.booking_day] if other[0] != x.stay_seq)
    assert want and sorted((x.booking_seq, x.stay_seq, x.alternate_seq, x.alternate_name, x.score) for x in found.collect()) == want


def test_a_written_report_leaves_no_copy(spark, tmp_path):
    c = Case()
    c.stay("a", "Mora, Eva", comments="Lantern 7/10, 7PM")
    c.stay("b", "Nash, Ida", "08/01/2026", "08/03/2026")
    c.book("x", "Eva Mora")
    r = reconcile(*c.frames(spark), SETTINGS)
    folder = run_folder(spark)
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    r.write(str(tmp_path / "report"))
    assert not [n for n in set(os.listdir(folder)) - before if n.startswith(("report_header", "report_line", "report_group"))]
    assert {x.arrival_month for x in read_report(spark, str(tmp_path / "report"), "report_header").collect()} == {"2026-07", "2026-08"}
