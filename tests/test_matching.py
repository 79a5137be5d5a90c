"""Matching, cross-check and report on one data set holding a case per rule."""

import datetime as dt

import pytest
from build import SETTINGS, Case
from pyspark.sql import functions as F

from stayledger import reconcile


@pytest.fixture(scope="module")
def case():
    c = Case()
    # dates
    c.stay("june", "Marlow, Nina", "06/29/2026", "07/02/2026")
    c.book("full month", "Nina Marlow", "June 29, 2026")
    c.book("bad date", "Nina Marlow", "someday")
    c.book("too late", "Nina Marlow", "Jul 2, 2026")
    # unit hints, party, outside
    c.stay("hint", "Ortega, Paul", unit="ASPEN")
    c.book("other unit", "Paul Ortega", tags="lantern BIRCH")
    c.book("right unit", "Paul Ortega", tags="Quarry's aspen RQ")
    c.book("no hint", "Paul Ortega", tags="lantern", party=5)
    c.book("outside", "Paul Ortega", tags="lantern off property")
    c.book("og in a word", "Paul Ortega", tags="lantern with dog")
    # ambiguous namesakes, with and without a settling note
    c.stay("tie a", "Quimby, Ada", departure="07/12/2026")
    c.stay("tie b", "Quimby, Bob", arrival="07/09/2026", departure="07/15/2026")
    c.book("tie", "QUIMBY")
    c.stay("note a", "Rosso, Ada", departure="07/12/2026")
    c.stay("note b", "Rosso, Bob", arrival="07/09/2026", departure="07/15/2026", comments="Lantern 7/10 @ 7PM")
    c.book("settled", "ROSSO", time="7:00", tags="lantern")
    # groups
    for i, unit in enumerate(("CEDAR", "HAZEL", "LARCH")):
        c.stay(f"family {i}", "Tanner, Lena", unit=unit)
    c.book("family", "TANNER", tags="lantern 3 rooms")
    c.book("sibling unit", "Lena Tanner", tags="lantern larch")
    c.stay("kin a", "Unger, Ida", unit="PINE")
    c.stay("kin b", "Unger, Max", unit="")
    # gates
    c.stay("gate", "Vargas, Grace")
    c.book("other first", "Kate Vargas")
    c.book("other last", "Grace Weller")
    c.book("typo", "Grace Vargs")
    c.stay("dots", "Ximenes, T.K.")
    c.book("dots", "TK Ximenes")
    c.stay("middle", "Brightwell, Rosalind F")
    c.book("middle", "Brightwel, Rosalin")
    c.stay("exact", "Zappa, Jon Lee", unit="ALDER")
    c.stay("near", "Zappa, Jon L", arrival="07/09/2026", unit="BEECH")
    c.book("near tie", "Jon Lee Zappa")
    # notes against bookings
    c.stay("venue", "Abbott, Ann", comments="lantern on 7/10 @ 7pm")
    c.book("venue", "Ann Abbott", tags="quarry ALDER")
    c.stay("time", "Bright, Ann", comments="Lantern 7/11 @ 7PM")
    c.book("time", "Ann Bright", "Jul 11, 2026", "6:30")
    c.stay("no time", "Corley, Ann", comments="Lantern 7/11")
    c.book("no time", "Ann Corley", "Jul 11, 2026", "6:30")
    c.stay("silent", "Dowden, Ann")
    c.book("silent", "Ann Dowden")
    c.stay("weekday", "Ewing, Ann", "08/03/2026", "08/19/2026", reservation="Quarry on a TUESDAY at 8:15 pm")
    c.book("weekday", "Ann Ewing", "Aug 11, 2026", "8:15", tags="quarry ALDER")
    c.stay("steal", "Fuller, Ann", comments="Lantern 7/12 @ 7PM, Lantern 7/11 @ 7PM")
    c.book("steal", "Ann Fuller", "Jul 11, 2026")
    c.stay("unbooked", "Grant, Ann", comments="Quarry 7/11 @ 7PM")
    # stays that must not match or break anything
    c.stay("backwards", "Hobbs, Ann", "07/13/2026", "07/10/2026")
    c.book("backwards", "Ann Hobbs", "Jul 11, 2026")
    c.stay("blank 1", "Ingram, Ann", conf="")
    c.stay("blank 2", "Jarvis, Ann", conf="")
    c.stay("copy", "Marlow, Nina", "06/29/2026", "07/02/2026", conf="C0")
    c.book("empty name", "")
    # moves
    c.stay("move a", "Keller, Ann", "07/10/2026", "07/12/2026", unit="ALDER", unit_type="T0")
    c.stay("move b", "Keller, Ann", "07/12/2026", "07/14/2026", unit="BEECH", unit_type="T2")
    c.stay("same type a", "Lowell, Ann", "07/10/2026", "07/12/2026", unit="ALDER", unit_type="T0")
    c.stay("same type b", "Lowell, Ann", "07/12/2026", "07/14/2026", unit="HAZEL", unit_type="T0")
    # roster checks
    c.stay("over", "Nolan, Ann", unit="ASPEN", guests=4, guest="Virtuoso client; breakfast incl.")
    c.stay("bed ok", "Olsen, Ann", unit="ALDER", guest="two cots please")
    c.stay("bed no", "Parks, Ann", unit="PINE", reservation="needs a rollaway")
    c.stay("mascot", "Quist, Ann", unit="PINE", guest="cottage mascot Scott")
    c.stay("pet no", "Reyes, Ann", unit="ROWAN", comments="one terrier, pet amenity bag")
    c.stay("pet ok", "Stone, Ann", unit="ALDER", comments="pet friendly please")
    return c


@pytest.fixture(scope="module")
def result(spark, case):
    return reconcile(*case.frames(spark), SETTINGS)


@pytest.fixture(scope="module")
def matches(result, case):
    rows = {r.booking_seq: r for r in result.matches.collect()}
    assert len(rows) == len(case.bookings)
    return {label: rows[n] for label, n in case.booking_no.items()}


def test_dates(matches, case):
    assert matches["full month"].stay_seq == case.stay_no["june"]
    assert matches["bad date"].flags == ["unparseable_reservation_date"]
    assert matches["too late"].flags == ["no_match_found"]


def test_hints_party_outside(matches, case):
    assert matches["other unit"].flags == ["room_mismatch"]
    assert matches["right unit"].flags == []
    assert matches["no hint"].flags == ["no_room_hint", "party_size_mismatch"]
    assert matches["outside"].flags == matches["og in a word"].flags == ["outside_guest"]
    assert matches["outside"].stay_seq is None


def test_whole_word_parameter(spark, case):
    from pyspark.sql import functions as F

    from stayledger.functions.text import is_outside
    df = spark.createDataFrame([("lantern with dog",), ("lantern og",)], "t string")
    got = [r[0] for r in df.select(is_outside(F.col("t"), SETTINGS.with_(outside_whole_word=True))).collect()]
    assert got == [False, True]


def test_ties(matches, case, result):
    tie, settled = matches["tie"], matches["settled"]
    assert tie.flags == ["ambiguous_name_match"] and tie.n_alternates == 1
    assert tie.stay_seq == case.stay_no["tie a"]
    assert settled.flags == ["resolved_by_note_time"] and settled.stay_seq == case.stay_no["note b"]
    listed = {(r.booking_name, r.stay_seq) for r in result.alternates.collect()}
    assert {("quimby", case.stay_no["tie a"]), ("quimby", case.stay_no["tie b"]),
            ("rosso", case.stay_no["note a"]), ("rosso", case.stay_no["note b"])} <= listed


def test_near_tie(matches, case):
    near = matches["near tie"]
    assert near.stay_seq == case.stay_no["exact"] and near.confidence == 100.0
    assert near.flags == ["ambiguous_name_match"] and near.n_alternates == 1


def test_groups(matches, case, result):
    assert matches["family"].stay_seq == case.stay_no["family 0"]
    assert matches["family"].flags == ["surname_only_no_room_hint"]
    assert matches["family"].group_size == 3
    assert "room_mismatch" not in matches["sibling unit"].flags
    groups = {}
    for r in result.groups.collect():
        groups.setdefault((r.group_id, r.matched_by), set()).add(r.stay_seq)
    assert groups == {
        (case.stay_no["family 0"], "exact_name"): {case.stay_no[f"family {i}"] for i in range(3)},
        (case.stay_no["kin a"], "same_surname"): {case.stay_no["kin a"], case.stay_no["kin b"]}}


def test_name_gates(matches, case):
    assert matches["other first"].flags == matches["other last"].flags == ["no_match_found"]
    assert matches["empty name"].flags == matches["backwards"].flags == ["no_match_found"]
    for label, stay in (("typo", "gate"), ("dots", "dots"), ("middle", "middle")):
        assert matches[label].stay_seq == case.stay_no[stay]


def test_cross_check(result, case):
    by_booking = {r.booking_seq: r for r in result.note_checks.collect() if r.booking_seq is not None}
    get = lambda label: by_booking[case.booking_no[label]]
    assert (get("venue").status, get("venue").mismatch_kind) == ("mismatch", "venue")
    assert get("time").status == "time_mismatch"
    assert get("no time").status == "matched"
    assert get("silent").status == "reservation_without_note"
    assert (get("weekday").status, get("weekday").mention_date) == ("matched", dt.date(2026, 8, 11))
    # The first mention falls back to the only booking; the exact one finds it used.
    assert (get("steal").status, get("steal").mismatch_kind) == ("mismatch", "date")
    open_ = [r.stay_seq for r in result.note_checks.collect() if r.status == "note_without_reservation"]
    assert {case.stay_no["steal"], case.stay_no["unbooked"]} <= set(open_)


def test_report_lines(result, case):
    lines = result.lines.collect()
    assert {r.stay_seq for r in lines} == set(range(len(case.stays)))
    by_booking = {r.booking_seq: r for r in lines if r.booking_seq is not None}
    sev = lambda label: by_booking[case.booking_no[label]].severity
    assert sev("no time") == 0 and sev("silent") == 2 and sev("venue") == 3
    assert sev("family") == 3 and sev("tie") == 3 and sev("settled") == 2
    kinds = {(r.stay_seq, r.line_kind, r.severity) for r in lines}
    assert (case.stay_no["unbooked"], "mention", 2) in kinds
    assert (case.stay_no["mascot"], "placeholder", 1) in kinds
    assert (case.stay_no["copy"], "duplicate", 3) in kinds


def test_headers_and_summary(result, case):
    heads = {r.stay_seq: r for r in result.headers.collect()}
    get = lambda label: heads[case.stay_no[label]]
    assert get("over").capacity_alert == 3 and get("over").consortium and get("over").breakfast
    assert get("bed ok").bed_requested and not get("bed ok").bed_alert
    assert get("bed no").bed_alert and not get("mascot").bed_alert
    assert get("pet no").pet_alert == "Lodge" and get("pet ok").pet_alert is None
    assert get("move a").move_note == "moves to BEECH on 07/12/2026"
    assert get("move b").move_note == "moved from ALDER on 07/12/2026"
    assert get("same type a").move_note is None
    assert get("family 1").other_units == 2 and get("family 1").group_size == 3
    assert get("kin b").other_units == 1 and get("kin a").other_units == 0
    assert get("copy").occurrences == 1 and get("copy").is_duplicate
    assert not get("blank 1").is_duplicate and not get("blank 2").is_duplicate
    s = result.summary.first()
    assert (s.total, s.unit_moves, s.group_bookings) == (len(case.stays), 1, 2)
    assert s.red + s.yellow + s.blue + s.green == s.total
    worst = {n: r.severity for n, r in heads.items()}
    assert s.red == sum(v == 3 for v in worst.values())


def test_pages_and_sink(spark, result, case, tmp_path):
    from stayledger.plans import report as R
    heads = result.headers.cache()
    n = heads.count()
    first = R.page_of(heads, 1, "name").collect()
    names = sorted((r.guest_name.lower() for r in heads.collect()))
    assert [r.guest_name.lower() for r in first] == names[:10]
    last = R.page_of(heads, 99, "name").collect()
    assert [r.guest_name.lower() for r in last] == names[(n - 1) // 10 * 10:]
    assert all(r.severity == 3 for r in R.select_headers(heads, [3], "AN").collect())
    order = R.in_report_order(heads).collect()
    assert order[-1].is_duplicate and order[0].arrival == min(r.arrival for r in order)
    for fmt in ("parquet", "json", "csv"):
        path = str(tmp_path / fmt)
        result.write(path, fmt)
        assert R.read_report(spark, path, "report_header", fmt).count() == n
        assert R.read_report(spark, path, "report_line", fmt).count() == result.lines.count()
        assert R.read_report(spark, path, "report_group", fmt).count() == result.groups.count()


def test_reports_are_published_whole(spark, result, tmp_path):
    from stayledger.plans import report as R
    path = str(tmp_path / "report")
    result.write(path)

    def shown():
        return sorted(map(str, R.read_report(spark, path, "report_header").collect()))

    first = shown()
    broken = {"report_header": result.headers, "report_line": result.lines.withColumn("x", F.raise_error(F.lit("lost")))}
    with pytest.raises(Exception, match="lost"):
        R.write_report(broken, result._dates, path)
    assert shown() == first
    result.write(path)  # again: the same report, not twice its rows
    assert shown() == first
    july = {"report_header": result.headers.where("arrival < DATE'2026-07-10'")}
    R.write_report(july, result._dates, path, keep_other_months=True)
    months = {r.arrival_month: r.version for r in R.manifest(spark, path).where("table_name = 'report_header'").collect()}
    assert set(months.values()) == {"report-00000001", "report-00000002"}
    kept = [r for r in R.read_report(spark, path, "report_header").collect()]
    assert {r.stay_seq for r in kept if months[r.arrival_month] == "report-00000001"} == {
        r.stay_seq for r in result.headers.collect() if r.arrival is None or f"{r.arrival:%Y-%m}" not in months or months[f"{r.arrival:%Y-%m}"] == "report-00000001"}


@pytest.mark.parametrize("size", [3, 64])
def test_cells_of_a_group_are_its_whole_list(spark, size):
    from stayledger.plans import report as R
    rows = [(1 if i % 5 else 2, i, "" if i % 7 == 0 else f"U{i}") for i in range(400)]
    members = spark.createDataFrame(rows, "group_id bigint, stay_seq bigint, unit string")
    cells = R.group_cells(members, size).orderBy("group_id", "cell").collect()
    for g in (1, 2):
        own = [c for c in cells if c.group_id == g]
        whole = [u for k, _, u in rows if k == g and u]
        assert ", ".join(c.units for c in own) == ", ".join(whole)
        assert [c.cell for c in own] == list(range(len(own))) and all(len(c.units.split(", ")) <= size for c in own)


def test_invariants(result, case):
    m = result.matches.collect()
    assert all((r.stay_seq is None) == (r.match_method == "none") for r in m)
    assert result.unmatched.count() == sum(r.stay_seq is None for r in m)
    checks = [r.booking_seq for r in result.note_checks.collect() if r.booking_seq is not None]
    assert len(checks) == len(set(checks)) == sum(r.stay_seq is not None for r in m)


def test_empty_bookings(spark, case):
    stays, bookings = case.frames(spark)
    r = reconcile(stays, bookings.limit(0), SETTINGS)
    assert r.matches.count() == 0
    assert r.summary.first().total == len(case.stays)


def test_a_week_end_to_end(spark):
    """15 stays and 8 bookings whose outcome is known: every severity, one move, two groups, a full unit."""
    c = Case()
    c.stay("green", "Hartley, Ines", "03/02/2027", "03/05/2027", unit="ALDER", comments="Lantern 3/3 @ 7PM")
    c.stay("hint", "Osei, Kwame", "03/02/2027", "03/06/2027", unit="MAPLE")
    for unit, guests in (("ASPEN", 4), ("BEECH", 4), ("PINE", 3)):
        c.stay(f"trio {unit}", "Sorrell, Bea", "03/03/2027", "03/05/2027", unit=unit, guests=guests)
    c.stay("silent", "Trask, Yann", "03/03/2027", "03/07/2027", unit="ROWAN")
    c.stay("first spell", "Ulvang, Kari", "03/01/2027", "03/04/2027", unit="CEDAR", unit_type="T1")
    c.stay("second spell", "Ulvang, Kari", "03/04/2027", "03/08/2027", unit="HAZEL", unit_type="T2")
    c.stay("weekday", "Varga, Lili", "03/02/2027", "03/05/2027", unit="LARCH", reservation="QUARRY WEDNESDAY 6:30 pm")
    c.stay("conflict", "Wexler, Dov", "03/04/2027", "03/06/2027", unit="STELM", comments="Lantern 3/5 @ 7PM")
    for name in ("Abara, Ike", "Abara, Uche"):
        c.stay(name, name, "03/06/2027", "03/09/2027", unit="RDGOAK")
    for name in ("Yilmaz, Ece", "Zorn, Piet", "Quint, Rhea"):
        c.stay(name, name, "03/05/2027", "03/07/2027", unit="BIRCH", guests=1)
    c.book("green", "Ines Hartley", "Mar 3, 2027", tags="lantern ALDER")
    c.book("hint", "Kwame Osei", "Mar 4, 2027", tags="lantern PINE")
    c.book("trio", "SORRELL", "Mar 4, 2027", party=4, tags="quarry")
    c.book("silent", "Yann Trask", "Mar 5, 2027", tags="quarry ROWAN")
    c.book("second spell", "Kari Ulvang", "Mar 5, 2027", tags="lantern HAZEL")
    c.book("weekday", "Lili Varga", "Mar 3, 2027", "6:30", tags="quarry LARCH")
    c.book("outside", "Noa Brandt", "Mar 3, 2027", tags="lantern off property")
    c.book("conflict", "Dov Wexler", "Mar 5, 2027", tags="quarry STELM")
    r = reconcile(*c.frames(spark), SETTINGS)
    flags = {x.booking_seq: (x.stay_seq, list(x["flags"])) for x in r.matches.collect()}
    stay, seq = c.stay_no, c.booking_no
    assert flags[seq["green"]] == (stay["green"], [])
    assert flags[seq["hint"]] == (stay["hint"], ["room_mismatch"])
    assert flags[seq["trio"]] == (stay["trio ASPEN"], ["surname_only_no_room_hint"])
    assert flags[seq["silent"]] == (stay["silent"], []) and flags[seq["second spell"]] == (stay["second spell"], [])
    assert flags[seq["outside"]] == (None, ["outside_guest"])
    heads = {x.stay_seq: x for x in r.headers.collect()}
    severity = {n: heads[stay[n]].severity for n in stay}
    assert [severity[n] for n in ("green", "weekday", "hint", "silent", "second spell", "trio ASPEN", "conflict")] == [0, 0, 2, 2, 2, 3, 3]
    s = r.summary.first()
    assert (s.total, s.green, s.yellow, s.red, s.blue, s.unit_moves, s.group_bookings) == (15, 2, 3, 2, 8, 1, 2)
    assert {n for n in stay if heads[stay[n]].capacity_alert} == {"trio ASPEN", "trio BEECH", "trio PINE"}
