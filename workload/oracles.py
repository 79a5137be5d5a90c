"""DuckDB SQL giving the expected result of every query, over the given tables.

The SQL states the rules directly - range joins, windows over all pairs, a recursive
fold - and shares nothing with the operators but the derived inputs.
"""

from __future__ import annotations

from stayledger.functions import notes as N
from stayledger.functions import text as T
from stayledger.settings import MONTHS, WEEKDAYS

from .derive import SETTINGS, duck_bookings, duck_stays
from .render import more


def _lcs(a: str, b: str) -> str:
    """Bit-parallel LCS length over HUGEINT (names here are far below 120 characters)."""
    full = f"((1::HUGEINT << length({a})) - 1)"
    mask = (f"list_transform(string_split({b}, ''), lambda c: coalesce(list_sum(list_transform("
            f"range(1, length({a}) + 1), lambda i: CASE WHEN {a}[i] = c THEN 1::HUGEINT << (i - 1) "
            f"ELSE 0::HUGEINT END))::HUGEINT, 0::HUGEINT))")
    left = (f"list_reduce(list_prepend({full}, {mask}), "
            f"lambda v, m: (((v + (v & m)) | (v - (v & m))) & {full}))")
    return f"(length({a}) - bit_count({left}))"


def _ratio(a: str, b: str) -> str:
    total = f"(length({a}) + length({b}))"
    return f"(100.0::DOUBLE * (1.0::DOUBLE - ({total} - 2 * {_lcs(a, b)})::DOUBLE / {total}::DOUBLE))"


def _clock(t: str) -> str:
    p = r"(\d{1,2})(?::(\d{2}))?"
    return (f"(TRY_CAST(regexp_extract({t}, '{p}', 1) AS INT) * 100 + "
            f"coalesce(TRY_CAST(nullif(regexp_extract({t}, '{p}', 2), '') AS INT), 0))")


def _venue(t: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({t}), '{k}') THEN '{v}'" for k, v in SETTINGS.venues) + " END"


def _has_venue(t: str) -> str:
    return "(" + " OR ".join(f"contains(lower({t}), '{k}')" for k, _ in SETTINGS.venues) + ")"


def _sorted_tokens(t: str) -> str:
    return f"array_to_string(list_sort(string_split_regex(trim({t}), '\\s+')), ' ')"


def _quoted(t: str) -> str:
    return "'" + t.replace("'", "''") + "'"


UNITS = "VALUES " + ", ".join(
    f"({_quoted(u.abbreviation)}, {_quoted(u.full_name)}, {_quoted(u.category)}, "
    f"{'NULL' if u.max_guests is None else u.max_guests}, {u.has_sofa_bed})" for u in SETTINGS.units)
ALIASES = "VALUES " + ", ".join(
    [f"({_quoted(t)}, {_quoted(c)}, 0)" for t, c in SETTINGS.misspellings]
    + [f"({_quoted(u.abbreviation)}, {_quoted(u.abbreviation)}, 1)" for u in SETTINGS.units]
    + [f"(upper(regexp_replace({_quoted(u.full_name)}, '[^A-Za-z]', '', 'g')), {_quoted(u.abbreviation)}, 2)"
       for u in SETTINGS.units])

_strip_words = "notes_tags"
for _w in [k for k, _ in SETTINGS.venues] + list(SETTINGS.outside_phrases):
    _strip_words = f"regexp_replace({_strip_words}, '{_w}', '', 'gi')"
_short = ", ".join(_quoted(t) for t in SETTINGS.shorthand)
HINT = (f"nullif(trim(array_to_string(list_filter(string_split_regex({_strip_words}, '[\\s,.\\-]+'), "
        f"lambda t: t <> '' AND lower(t) NOT IN ({_short})), ' '), ' -,.'), '')")
OUTSIDE = "(" + " OR ".join(f"contains(lower(notes_tags), '{p}')" for p in SETTINGS.outside_phrases) + ")"

NAME_PARTS = """
  trim(CASE WHEN contains(k, ',') THEN split_part(k, ',', 1) ELSE string_split_regex(k, '\\s+')[-1] END) AS sur,
  CASE WHEN contains(k, ',') THEN replace(split_part(trim(substr(k, strpos(k, ',') + 1)), ' ', 1), '.', '')
       WHEN len(string_split_regex(k, '\\s+')) >= 2 THEN replace(string_split_regex(k, '\\s+')[1], '.', '') END AS fst,
  NOT contains(k, ',') AND len(string_split_regex(k, '\\s+')) = 1 AS bare,
  CASE WHEN contains(k, ',') THEN trim(substr(k, strpos(k, ',') + 1)) || ' ' || trim(split_part(k, ',', 1))
       WHEN len(string_split_regex(k, '\\s+')) >= 2 THEN string_split_regex(k, '\\s+')[-1] || ', ' ||
            array_to_string(list_slice(string_split_regex(k, '\\s+'), 1, len(string_split_regex(k, '\\s+')) - 1), ' ')
  END AS swapped
"""

HEADER = ["stay_seq", "confirmation_number", "guest_name", "arrival", "severity", "n_lines", "consortium", "breakfast", "pet", "bed_requested", "bed_alert",
          "capacity_alert", "pet_alert", "move_note", "group_id", "matched_by", "group_size", "other_units", "is_duplicate", "occurrences"]


def _cells(columns: list[str]) -> str:
    return "concat_ws('|', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '-')" for c in columns) + ")"


# --- building blocks, in order of dependency -------------------------------------------

CTE: dict[str, tuple[tuple[str, ...], str]] = {}


def _cte(name: str, needs: tuple[str, ...], sql: str) -> None:
    CTE[name] = (needs, sql)


_cte("s0", (), duck_stays())
_cte("b0", (), duck_bookings())
_cte("units", (), f"SELECT * FROM ({UNITS}) t(abbreviation, full_name, category, max_guests, has_sofa_bed)")
_cte("aliases", (), f"SELECT * FROM ({ALIASES}) t(token, abbreviation, prio)")
_cte("s1", ("s0",), """SELECT *, lower(trim(guest_name)) AS name_key,
    CAST(try_strptime(trim(arrival_date), '%m/%d/%Y') AS DATE) AS arrival,
    CAST(try_strptime(trim(departure_date), '%m/%d/%Y') AS DATE) AS departure,
    row_number() OVER (PARTITION BY confirmation_number ORDER BY stay_seq) AS copy_no,
    count(*) OVER (PARTITION BY confirmation_number) AS copies FROM s0""")
_cte("s", ("s1",), "SELECT * FROM s1 WHERE copy_no = 1 OR confirmation_number = ''")
_cte("dups", ("s1",), "SELECT *, copies - 1 AS occurrences FROM s1 WHERE copy_no > 1 AND confirmation_number <> ''")
_cte("hints", ("b0", "aliases"), f"""SELECT booking_seq, hint AS unit_hint, min_by(abbreviation, pos * 10 + prio) AS hinted_unit FROM (
    SELECT booking_seq, hint, unnest(grams) AS token, generate_subscripts(grams, 1) AS pos FROM (
      SELECT booking_seq, hint, list_concat(list_concat(
          CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || w[i+1] || w[i+2]) ELSE [] END,
          CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || w[i+1]) ELSE [] END), w) AS grams
      FROM (SELECT booking_seq, hint, list_transform(regexp_extract_all(trim(regexp_replace(hint, '^''?s\\b\\s*', '', 'i')), '[A-Za-z]+'), lambda x: upper(x)) AS w
            FROM (SELECT booking_seq, {HINT} AS hint FROM b0) h0) h1) h2) h3
    JOIN aliases USING (token) GROUP BY booking_seq, hint""")
_cte("b", ("b0", "hints"), f"""SELECT b0.*, lower(trim(guest_name)) AS booking_name,
    CAST(try_strptime(trim(source_date), '%b %d, %Y') AS DATE) AS booking_day, {_venue('notes_tags')} AS venue,
    {OUTSIDE} AS is_outside, {HINT} AS unit_hint, hints.hinted_unit, {_clock('booking_time')} AS booking_clock
    FROM b0 LEFT JOIN hints USING (booking_seq)""")
_cte("sn", ("s",), f"SELECT k, sur, nullif(fst, '') AS fst, {_sorted_tokens('k')} AS t1, {_sorted_tokens('swapped')} AS t2 "
     f"FROM (SELECT k, {NAME_PARTS} FROM (SELECT DISTINCT name_key AS k FROM s) q) q2")
_cte("bn", ("b",), f"SELECT k, sur, nullif(fst, '') AS fst, bare, {_sorted_tokens('k')} AS t1, {_sorted_tokens('swapped')} AS t2 "
     f"FROM (SELECT k, {NAME_PARTS} FROM (SELECT DISTINCT booking_name AS k FROM b WHERE booking_day IS NOT NULL AND NOT is_outside) q) q2")
_cte("sur_ok", ("sn", "bn"), f"SELECT a, b FROM (SELECT DISTINCT sur AS a FROM sn) x, (SELECT DISTINCT sur AS b FROM bn) y WHERE {_ratio('a', 'b')} >= 85")
_cte("fst_ok", ("sn", "bn"), f"SELECT a, b FROM (SELECT DISTINCT fst AS a FROM sn WHERE fst IS NOT NULL) x, (SELECT DISTINCT fst AS b FROM bn WHERE fst IS NOT NULL) y WHERE {_ratio('a', 'b')} >= 85")
_cte("name_pairs", ("sn", "bn", "sur_ok", "fst_ok"), """SELECT sn.k AS stay_name, bn.k AS booking_name, sn.t1 AS s1, sn.t2 AS s2, bn.t1 AS b1, bn.t2 AS b2, bn.bare, sn.sur AS ssur
    FROM sn, bn WHERE bn.bare OR (EXISTS (SELECT 1 FROM sur_ok WHERE a = sn.sur AND b = bn.sur)
      AND (sn.fst IS NULL OR bn.fst IS NULL OR EXISTS (SELECT 1 FROM fst_ok WHERE a = sn.fst AND b = bn.fst)))""")
_r = lambda a, b: f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {_ratio(a, b)} END"
_cte("scores", ("name_pairs",), f"""SELECT * FROM (SELECT booking_name, stay_name,
    greatest({_r('s1', 'b1')}, {_r('s1', 'b2')}, {_r('s2', 'b1')}, {_r('s2', 'b2')},
      CASE WHEN bare THEN {_ratio('ssur', 'b1')} END) AS score FROM name_pairs) q WHERE score >= 72""")
_cte("grp", ("s",), """SELECT stay_seq, CASE WHEN n > 1 THEN g1 WHEN fam > 1 THEN g2 END AS group_id,
    CASE WHEN n > 1 THEN 'exact_name' WHEN fam > 1 THEN 'same_surname' END AS matched_by,
    CASE WHEN n > 1 THEN n WHEN fam > 1 THEN fam END AS group_size FROM (
      SELECT *, CASE WHEN n = 1 THEN count(*) FILTER (n = 1) OVER f END AS fam,
        min(stay_seq) FILTER (n = 1) OVER f AS g2 FROM (
          SELECT stay_seq, arrival_date, departure_date, split_part(name_key, ',', 1) AS sur,
            count(*) OVER e AS n, min(stay_seq) OVER e AS g1 FROM s
          WINDOW e AS (PARTITION BY name_key, arrival_date, departure_date)) q
      WINDOW f AS (PARTITION BY sur, arrival_date, departure_date)) q2
    WHERE n > 1 OR fam > 1""")
_cte("cands", ("s", "b", "scores", "grp"), """SELECT b.booking_seq, s.stay_seq, sc.score, grp.group_id,
    row_number() OVER (PARTITION BY b.booking_seq ORDER BY sc.score DESC, s.stay_seq) AS rn
    FROM b JOIN scores sc USING (booking_name) JOIN s ON s.name_key = sc.stay_name AND s.arrival <= b.booking_day AND b.booking_day < s.departure
    LEFT JOIN grp ON grp.stay_seq = s.stay_seq WHERE NOT b.is_outside""")
_cte("ranked", ("cands",), """SELECT *, top = score AS is_top, CASE WHEN one_group THEN 'clear' WHEN n_top > 1 THEN 'tied'
      WHEN second IS NOT NULL AND top - second < 8 THEN 'near_tie' ELSE 'clear' END AS outcome FROM (
    SELECT *, coalesce(lead_group IS NOT NULL AND n_top = count(*) FILTER (score = top AND group_id = lead_group) OVER w, FALSE) AS one_group FROM (
      SELECT *, count(*) FILTER (score = top) OVER w AS n_top FROM (
        SELECT *, max(score) OVER w AS top, max(CASE WHEN rn = 2 THEN score END) OVER w AS second,
          max(CASE WHEN rn = 1 THEN group_id END) OVER w AS lead_group, max(CASE WHEN rn = 1 THEN stay_seq END) OVER w AS leader
        FROM cands WINDOW w AS (PARTITION BY booking_seq)) q WINDOW w AS (PARTITION BY booking_seq)) q2
      WINDOW w AS (PARTITION BY booking_seq)) q3""")

# The marked patterns of the grammar, without Java's flag for Unicode classes.
_TIME, _NUM, _DAY, _SPELL = (p.replace("(?U)", "").replace("(?iU)", "(?i)") for p in (N.TIME, N.NUMERIC, N.WEEKDAY, N.SPELLED))
_months = "[" + ", ".join(_quoted(m) for m in MONTHS) + "]"
_days = "[" + ", ".join(_quoted(d) for d in WEEKDAYS) + "]"
_cte("pieces", ("s",), r"""SELECT stay_seq, arrival, departure, field_ord, seg, piece, pos FROM (
    SELECT *, unnest(ps) AS piece, generate_subscripts(ps, 1) AS pos FROM (
      SELECT *, string_split(regexp_replace(part, ',(\s*[A-Za-z0-9/])', chr(1) || '\1', 'g'), chr(1)) AS ps FROM (
        SELECT stay_seq, arrival, departure, field_ord, unnest(parts) AS part, generate_subscripts(parts, 1) AS seg FROM (
          SELECT stay_seq, arrival, departure, field_ord, string_split_regex(txt, '\n\n+') AS parts FROM (
            SELECT stay_seq, arrival, departure, 0 AS field_ord, guest_notes AS txt FROM s
            UNION ALL SELECT stay_seq, arrival, departure, 1, reservation_notes FROM s
            UNION ALL SELECT stay_seq, arrival, departure, 2, comments_notes FROM s) f WHERE txt <> '') g) h) i) j
    WHERE NOT (pos = 1 AND piece = '')""")
_cte("entries", ("pieces",), f"""SELECT * FROM (SELECT stay_seq, arrival, departure, field_ord,
      row_number() OVER (PARTITION BY stay_seq, field_ord ORDER BY seg, island) - 1 AS entry_ord, entry FROM (
        SELECT stay_seq, arrival, departure, field_ord, seg, island, trim(string_agg(piece, ',' ORDER BY pos)) AS entry FROM (
          SELECT *, sum(CASE WHEN nth > 1 AND {_has_venue('piece')} THEN 1 ELSE 0 END)
            OVER (PARTITION BY stay_seq, field_ord, seg ORDER BY pos) AS island FROM (
              SELECT *, row_number() OVER (PARTITION BY stay_seq, field_ord, seg ORDER BY pos) AS nth FROM pieces) q0) q1
        GROUP BY ALL) q2 WHERE entry <> '') q3 WHERE {_has_venue('entry')}""")
_cte("mentions", ("entries",), f"""SELECT stay_seq, field_ord, entry_ord, venue, time_text, weekday_text, entry, wk, occ, style,
    occ_n > 1 AS is_ambiguous, generate_subscripts(days, 1) - 1 AS date_ord, unnest(days) AS resolved_date, arrival, departure,
    concat_ws(';', CASE WHEN style = 'no_stay_dates' THEN 'unparseable_stay_dates' END,
      CASE WHEN style IN ('numeric', 'spelled') AND d1 IS NULL THEN 'date_outside_stay_window' END,
      CASE WHEN occ_n > 1 THEN 'ambiguous_weekday' END, CASE WHEN style = 'none' THEN 'no_date_found_in_note' END) AS flags
  FROM (SELECT *, CASE WHEN style = 'numeric' AND d2 IS NOT NULL AND day2 IS NOT NULL THEN [d1, day2]
                       WHEN style IN ('numeric', 'spelled') THEN [d1]
                       WHEN occ_n = 1 THEN [occ[1]] ELSE [NULL::DATE] END AS days FROM (
    SELECT *, TRY_CAST(year(d1) || '-' || month(d1) || '-' || d2 AS DATE) AS day2 FROM (
      SELECT *, coalesce(CASE WHEN y1 BETWEEN arrival AND departure THEN y1 END, CASE WHEN y2 BETWEEN arrival AND departure THEN y2 END, y1) AS d1 FROM (
        SELECT *, CASE WHEN style IN ('numeric', 'spelled') THEN TRY_CAST(year(arrival) || '-' || mm || '-' || dd AS DATE) END AS y1,
          CASE WHEN style IN ('numeric', 'spelled') THEN TRY_CAST(year(departure) || '-' || mm || '-' || dd AS DATE) END AS y2,
          CASE WHEN style = 'weekday' THEN list_filter(list_transform(range(0, greatest(departure - arrival, 0)), lambda i: arrival + CAST(i AS INT)), lambda d: isodow(d) - 1 = wk) ELSE [] END AS occ,
          len(CASE WHEN style = 'weekday' THEN list_filter(list_transform(range(0, greatest(departure - arrival, 0)), lambda i: arrival + CAST(i AS INT)), lambda d: isodow(d) - 1 = wk) ELSE [] END) AS occ_n FROM (
          SELECT *, CASE WHEN arrival IS NULL OR departure IS NULL THEN 'no_stay_dates' WHEN m IS NOT NULL THEN 'numeric'
              WHEN sm <> '' THEN 'spelled' WHEN weekday_text IS NOT NULL THEN 'weekday' ELSE 'none' END AS style,
            coalesce(m, CAST(list_position({_months}, lower(sm)) AS VARCHAR)) AS mm, CASE WHEN m IS NOT NULL THEN d ELSE sd END AS dd,
            list_position({_days}, weekday_text) - 1 AS wk FROM (
            SELECT *, {_venue('entry')} AS venue, nullif(regexp_extract(entry, '{_TIME}', 0), '') AS time_text,
              nullif(upper(regexp_extract(entry, '{_DAY}', 1)), '') AS weekday_text,
              nullif(regexp_extract(entry, '{_NUM}', 1), '') AS m, regexp_extract(entry, '{_NUM}', 2) AS d,
              nullif(regexp_extract(entry, '{_NUM}', 3), '') AS d2, regexp_extract(entry, '{_SPELL}', 1) AS sm, regexp_extract(entry, '{_SPELL}', 2) AS sd
            FROM entries) a) b1) c) d0) e) f""")
_cte("note_agrees", ("ranked", "b", "mentions"), f"""SELECT DISTINCT r.booking_seq, r.stay_seq FROM ranked r JOIN b USING (booking_seq)
    JOIN mentions m ON m.stay_seq = r.stay_seq AND m.venue = b.venue
      AND (m.resolved_date = b.booking_day OR (m.is_ambiguous AND list_contains(m.occ, b.booking_day)))
      AND {_clock('m.time_text')} = b.booking_clock
    WHERE (r.outcome = 'tied' AND r.is_top) OR (r.outcome = 'near_tie' AND r.top - r.score < 8)""")
_cte("chosen", ("note_agrees",), "SELECT booking_seq, min(stay_seq) AS note_stay FROM note_agrees GROUP BY booking_seq HAVING count(*) = 1")
_cte("sets", ("ranked",), """SELECT booking_seq, any_value(outcome) AS outcome, any_value(top) AS top, any_value(leader) AS leader,
    CASE any_value(outcome) WHEN 'tied' THEN any_value(n_top) WHEN 'near_tie' THEN count(*) FILTER (top - score < 8) ELSE 1 END - 1 AS n_alternates
    FROM ranked GROUP BY booking_seq""")
_cte("matches", ("b", "s", "sets", "chosen", "grp"), """SELECT b.*, CASE WHEN sets.leader IS NULL THEN 'none' ELSE 'name' END AS match_method,
    coalesce(chosen.note_stay, sets.leader) AS stay_seq, sets.top AS confidence, sets.n_alternates, own.group_id, own.group_size,
    concat_ws(';', CASE WHEN b.booking_day IS NULL THEN 'unparseable_reservation_date' WHEN b.is_outside THEN 'outside_guest'
        WHEN sets.leader IS NULL THEN 'no_match_found' END,
      CASE WHEN sets.outcome <> 'clear' THEN CASE WHEN chosen.note_stay IS NOT NULL THEN 'resolved_by_note_time' ELSE 'ambiguous_name_match' END END,
      CASE WHEN sets.outcome = 'clear' AND b.hinted_unit IS NOT NULL AND st.unit <> '' AND NOT EXISTS (
          SELECT 1 FROM s x LEFT JOIN grp g ON g.stay_seq = x.stay_seq
          WHERE upper(trim(x.unit)) = b.hinted_unit AND (x.stay_seq = st.stay_seq OR g.group_id = own.group_id)) THEN 'room_mismatch' END,
      CASE WHEN sets.outcome = 'clear' AND b.hinted_unit IS NULL THEN CASE WHEN NOT contains(b.booking_name, ',') AND NOT contains(b.booking_name, ' ')
          THEN 'surname_only_no_room_hint' ELSE 'no_room_hint' END END,
      CASE WHEN sets.outcome = 'clear' AND b.party_size <> st.guests_count THEN 'party_size_mismatch' END) AS flags
    FROM b LEFT JOIN sets USING (booking_seq) LEFT JOIN chosen USING (booking_seq) LEFT JOIN s st ON st.stay_seq = sets.leader
    LEFT JOIN grp own ON own.stay_seq = coalesce(chosen.note_stay, sets.leader)""")
_cte("said", ("mentions",), """SELECT *, row_number() OVER (PARTITION BY stay_seq ORDER BY field_ord, entry_ord, date_ord) - 1 AS mention_ord FROM mentions""")
_cte("booked", ("matches",), """SELECT stay_seq, list({'seq': booking_seq, 'day': booking_day, 'venue': venue, 'clock': booking_clock} ORDER BY booking_seq) AS bl
    FROM matches WHERE stay_seq IS NOT NULL GROUP BY stay_seq""")
_cte("said2", ("said", "booked"), """SELECT said.*, coalesce(bl, []) AS bl,
    CASE WHEN is_ambiguous AND len(hits) = 1 THEN hits[1] END AS settled,
    coalesce(resolved_date, CASE WHEN is_ambiguous AND len(hits) = 1 THEN hits[1] END) AS mday FROM (
      SELECT said.*, bl, list_distinct(list_transform(list_filter(bl, lambda x: x.venue = said.venue AND list_contains(said.occ, x.day)), lambda x: x.day)) AS hits
      FROM said LEFT JOIN booked USING (stay_seq)) said""")
_free = "NOT list_contains(f.used, x.seq)"
_cte("fold", ("said2",), f"""SELECT DISTINCT stay_seq, CAST(-1 AS BIGINT) AS mention_ord, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS pick FROM said2
    UNION ALL
    SELECT stay_seq, nxt, CASE WHEN p IS NULL THEN used ELSE list_append(used, p) END, p FROM (
      SELECT f.stay_seq, m.mention_ord AS nxt, f.used, CASE WHEN m.mday IS NOT NULL THEN coalesce(
          list_filter(m.bl, lambda x: {_free} AND x.day = m.mday AND coalesce(x.venue = m.venue, FALSE))[1].seq,
          list_filter(m.bl, lambda x: {_free} AND x.day = m.mday AND NOT coalesce(x.venue = m.venue, FALSE))[1].seq,
          list_filter(m.bl, lambda x: {_free} AND coalesce(x.venue = m.venue, FALSE))[1].seq) END AS p
      FROM fold f JOIN said2 m ON m.stay_seq = f.stay_seq AND m.mention_ord = f.mention_ord + 1) q""")
_cte("checks", ("said2", "fold", "matches"), f"""SELECT m.stay_seq, m.mention_ord, m.field_ord, m.venue, m.mday, m.time_text, m.entry, m.is_ambiguous AS was_ambiguous, m.settled,
    fold.pick AS booking_seq, CASE WHEN fold.pick IS NULL THEN 'note_without_reservation'
      WHEN NOT (x.booking_day = m.mday AND coalesce(x.venue = m.venue, FALSE)) THEN 'mismatch'
      WHEN m.time_text IS NOT NULL AND NOT coalesce({_clock('m.time_text')} = x.booking_clock, FALSE) THEN 'time_mismatch' ELSE 'matched' END AS status,
    CASE WHEN fold.pick IS NULL THEN NULL WHEN NOT (x.booking_day = m.mday) THEN 'date' WHEN NOT coalesce(x.venue = m.venue, FALSE) THEN 'venue'
      WHEN m.time_text IS NOT NULL AND NOT coalesce({_clock('m.time_text')} = x.booking_clock, FALSE) THEN 'time' END AS mismatch_kind
    FROM said2 m JOIN fold USING (stay_seq, mention_ord) LEFT JOIN matches x ON x.booking_seq = fold.pick""")
_cte("checked", ("matches", "checks"), """SELECT x.*, c.mention_ord, c.venue AS mvenue, c.mday, c.time_text, coalesce(c.status, 'reservation_without_note') AS status, c.mismatch_kind
    FROM matches x LEFT JOIN checks c ON c.booking_seq = x.booking_seq WHERE x.stay_seq IS NOT NULL""")
_hard = """CASE WHEN status IN ('mismatch', 'time_mismatch') THEN 'note_mismatch' WHEN contains(flags, 'surname_only_no_room_hint') THEN 'surname_only'
    WHEN contains(flags, 'ambiguous_name_match') THEN 'ambiguous' END"""
_cte("blines", ("checked", "s"), f"""SELECT stay_seq, 'booking' AS line_kind, CASE WHEN hard IS NOT NULL THEN 3 WHEN soft <> '' THEN 2 ELSE 0 END AS severity,
    coalesce(hard, soft) AS reasons, booking_seq, CAST(NULL AS BIGINT) AS mention_ord,
    CASE WHEN mismatch_kind = 'time' THEN said || ', the booking is at ' || booking_time
         WHEN mismatch_kind = 'venue' THEN said || ', the booking of that day is at ' || coalesce(venue, 'an unknown venue')
         WHEN mismatch_kind = 'date' THEN said || ', the booking is on ' || source_date
         WHEN hard IS NULL AND contains(flags, 'party_size_mismatch') THEN 'party of ' || party_size || ' booked, ' || guests_count || ' on the roster'
         ELSE '' END AS detail FROM (
    SELECT c.*, s.guests_count, {_hard} AS hard, concat_ws(' ', 'the notes say', time_text, mvenue, 'on', CAST(mday AS VARCHAR)) AS said,
      concat_ws(';', CASE WHEN contains(flags, 'resolved_by_note_time') THEN 'resolved_by_note' END, CASE WHEN contains(flags, 'room_mismatch') THEN 'room_mismatch' END,
        CASE WHEN list_contains(string_split(flags, ';'), 'no_room_hint') THEN 'no_room_hint' END, CASE WHEN contains(flags, 'party_size_mismatch') THEN 'party_size_mismatch' END,
        CASE WHEN status = 'reservation_without_note' THEN 'not_in_notes' END) AS soft
    FROM checked c JOIN (SELECT stay_seq, guests_count FROM s) s ON s.stay_seq = c.stay_seq) q""")
_cte("found", ("blines", "checks"), """SELECT * FROM blines UNION ALL SELECT stay_seq, 'mention', 2, 'no_booking_for_note', NULL, mention_ord, entry
    FROM checks WHERE status = 'note_without_reservation'""")
_cte("lines", ("found", "s", "dups"), """SELECT * FROM found
    UNION ALL SELECT stay_seq, 'placeholder', 1, 'nothing_to_compare', NULL, NULL, '' FROM s WHERE stay_seq NOT IN (SELECT stay_seq FROM found)
    UNION ALL SELECT stay_seq, 'duplicate', 3, 'duplicate_confirmation', NULL, NULL, 'copies set aside: ' || occurrences FROM dups""")
_all_notes = "(guest_notes || ' ' || reservation_notes || ' ' || comments_notes)"
_BED, _BREAKFAST, _PET, _CONSORTIUM = (p.replace("(?U)", "") for p in (T.EXTRA_BED, T.BREAKFAST, T.PET, T.CONSORTIUM))
_cte("roster", ("s", "units"), f"""SELECT s.stay_seq, regexp_matches({_all_notes}, '{_CONSORTIUM}') AS consortium,
    regexp_matches({_all_notes}, '{_BREAKFAST}') AS breakfast, regexp_matches({_all_notes}, '{_PET}') AS pet,
    regexp_matches({_all_notes}, '{_BED}') AS bed_request, category, has_sofa_bed, max_guests, guests_count
    FROM s LEFT JOIN units u ON u.abbreviation = trim(s.unit)""")
_cte("moves", ("s",), """SELECT e.stay_seq AS earlier_seq, l.stay_seq AS later_seq, e.name_key, e.departure_date AS move_date, e.unit AS earlier_unit,
    e.unit_type AS earlier_type, l.unit AS later_unit, l.unit_type AS later_type FROM s e JOIN s l ON e.name_key = l.name_key
    AND e.departure_date = l.arrival_date AND e.unit <> l.unit AND e.unit_type <> l.unit_type""")
_cte("move_notes", ("moves", "s"), """SELECT coalesce(a.stay_seq, c.stay_seq) AS stay_seq, moved_to_seq, moved_to_unit, moved_from_seq, moved_from_unit FROM
    (SELECT earlier_seq AS stay_seq, max(later_seq) AS moved_to_seq, max_by(later_unit, later_seq) AS moved_to_unit FROM moves GROUP BY 1) a
    FULL JOIN (SELECT later_seq AS stay_seq, max(earlier_seq) AS moved_from_seq, max_by(earlier_unit, earlier_seq) AS moved_from_unit FROM moves GROUP BY 1) c USING (stay_seq)""")
_cte("heads", ("s", "dups", "found", "roster", "move_notes", "grp"), """SELECT s.stay_seq, s.confirmation_number, s.guest_name, s.arrival, coalesce(f.worst, 1) AS severity, coalesce(f.n, 1) AS n_lines,
    consortium, breakfast, pet, coalesce(bed_request AND has_sofa_bed, FALSE) AS bed_requested, coalesce(bed_request AND NOT has_sofa_bed, FALSE) AS bed_alert,
    CASE WHEN r.guests_count > max_guests THEN max_guests END AS capacity_alert, CASE WHEN pet AND category <> 'Cabins' THEN category END AS pet_alert,
    CASE WHEN moved_to_seq IS NOT NULL THEN 'moves to ' || moved_to_unit || ' on ' || s.departure_date
         WHEN moved_from_seq IS NOT NULL THEN 'moved from ' || moved_from_unit || ' on ' || s.arrival_date END AS move_note,
    g.group_id, g.matched_by, g.group_size,
    (SELECT CASE WHEN g.group_id IS NOT NULL THEN count(*) END FROM s o JOIN grp og ON og.stay_seq = o.stay_seq
       WHERE og.group_id = g.group_id AND o.stay_seq <> s.stay_seq AND o.unit <> '') AS other_units,
    FALSE AS is_duplicate, CAST(NULL AS BIGINT) AS occurrences
    FROM s LEFT JOIN (SELECT stay_seq, max(severity) AS worst, count(*) AS n FROM found GROUP BY 1) f ON f.stay_seq = s.stay_seq
    JOIN roster r ON r.stay_seq = s.stay_seq LEFT JOIN move_notes mn ON mn.stay_seq = s.stay_seq LEFT JOIN grp g ON g.stay_seq = s.stay_seq
    UNION ALL SELECT stay_seq, confirmation_number, guest_name, arrival, 3, 1, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, TRUE, occurrences FROM dups""")
_cte("printed", ("s0",), """SELECT 'arrivals-' || lpad(CAST(stay_seq // 1000 AS VARCHAR), 8, '0') AS doc, CAST(stay_seq % 1000 // 20 AS INT) + 1 AS page,
    stay_seq % 20 AS slot, * REPLACE (replace(comments_notes, chr(10) || chr(10), ' ') AS comments_notes) FROM s0""")


# The records as the parsers number and read them: by document path, then in the document.
_EXPORT = "'export-' || CASE WHEN source_date = 'n/a' THEN 'undated' ELSE replace(replace(source_date, ',', ''), ' ', '-') END"
PARSED = {
    "s0": f"""SELECT * REPLACE ((stay_seq // 1000) * 4294967296 + stay_seq % 1000 + 1 AS stay_seq, CASE WHEN departure_date = 'TBD' THEN '' ELSE departure_date END AS departure_date,
        replace(comments_notes, chr(10) || chr(10), ' ') AS comments_notes) FROM ({duck_stays()}) w""",
    "b0": f"""SELECT * EXCLUDE (doc, before) REPLACE ((before + dense_rank() OVER (ORDER BY doc) - 1) * 4294967296 + row_number() OVER (PARTITION BY doc ORDER BY booking_seq) AS booking_seq)
        FROM (SELECT *, {_EXPORT} AS doc, (SELECT count(DISTINCT stay_seq // 1000) FROM ({duck_stays()}) w0) AS before FROM ({duck_bookings()}) w1) w2"""}


def _with(needs: list[str], sql: str, swap: dict[str, str] | None = None) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        for n in CTE[name][0]:
            visit(n)
        if name not in order:
            order.append(name)

    for name in needs:
        visit(name)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({(swap or {}).get(n, CTE[n][1])})" for n in order) + "\n" + sql


_MORE = f"trim({more(0)} || ' ' || {more(1)})"
PRINTED = r"""SELECT doc, CASE WHEN slot = 19 AND k >= 3 THEN page + 1 ELSE page END AS page, CASE WHEN slot = 19 AND k >= 3 THEN -1 ELSE slot END AS slot, k, txt FROM (
        SELECT DISTINCT doc, page, CAST(-1 AS BIGINT) AS slot, 0 AS k, 'Arrivals with Details' AS txt FROM printed
        UNION ALL SELECT doc, page, slot, 0, concat_ws(' ', nullif(unit, ''), guest_name, status, arrival_date, coalesce(CAST(guests_count AS VARCHAR), 'n'), '/ 0 LEIS') FROM printed
        UNION ALL SELECT doc, page, slot, 1, concat_ws(' ', unit_type, confirmation_number, departure_date) FROM printed
        UNION ALL SELECT doc, page, slot, 2, 'Guest Notes: ' || guest_notes FROM printed WHERE guest_notes <> ''
        UNION ALL SELECT doc, page, slot, 3, 'Reservation Notes: ' || reservation_notes FROM printed WHERE reservation_notes <> ''
        UNION ALL SELECT doc, page, slot, 4, 'Comments / Notes: ' || comments_notes FROM printed WHERE comments_notes <> ''
        UNION ALL SELECT doc, page, slot, 5, @ FROM printed WHERE @ <> ''
        UNION ALL SELECT doc, max(page), 99, 0, 'Total Reservations ' || (count(*) + max(stay_seq // 1000) % 2) FROM printed GROUP BY doc) pr""".replace("@", _MORE)
_FIELDS = "['guest_notes', 'reservation_notes', 'comments_notes'][field_ord + 1]"

ORACLES: dict[str, str] = {
    "stay_fields": _with(["s1"], f"""SELECT stay_seq, arrival, departure, CASE WHEN departure >= arrival THEN CAST(departure - arrival AS VARCHAR) ELSE '' END AS nights,
        CASE WHEN departure > arrival THEN departure - arrival ELSE 0 END AS n_nights, sur AS surname, fst AS first_name, swapped AS swapped_name, sur AS group_surname
        FROM (SELECT *, name_key AS k, {NAME_PARTS} FROM (SELECT stay_seq, arrival, departure, name_key, name_key AS k FROM s1) q0) q"""),
    "booking_fields": _with(["b"], """SELECT booking_seq, booking_day, booking_clock, venue, is_outside, unit_hint, CASE WHEN venue IS NULL THEN 'no_restaurant_detected' ELSE '' END AS flags,
        NOT contains(booking_name, ',') AND NOT contains(booking_name, ' ') AS bare FROM b"""),
    "inhouse_join": _with(["b", "s"], """SELECT b.booking_seq, count(*) AS in_house, min(s.stay_seq) AS first_stay FROM b JOIN s ON s.arrival <= b.booking_day AND b.booking_day < s.departure GROUP BY 1"""),
    "name_score": _with(["scores"], "SELECT booking_name, stay_name, round(score, 6) AS score FROM scores"),
    "match_bookings": _with(["matches"], "SELECT booking_seq, match_method, stay_seq, round(confidence, 6) AS confidence, flags, n_alternates, group_id FROM matches"),
    "unmatched_bookings": _with(["matches"], "SELECT booking_seq, guest_name, source_date, flags AS reason FROM matches WHERE match_method = 'none'"),
    "match_alternates": _with(["ranked", "b", "s"], """SELECT DISTINCT b.booking_name, b.booking_day AS night, r.stay_seq, s.guest_name, round(r.score, 6) AS score, r.stay_seq = r.leader AS is_leader
        FROM ranked r JOIN b USING (booking_seq) JOIN s ON s.stay_seq = r.stay_seq
        WHERE (r.outcome = 'tied' AND r.is_top) OR (r.outcome = 'near_tie' AND r.top - r.score < 8)"""),
    "match_siblings": _with(["matches", "grp", "s"], """SELECT m.booking_seq, m.stay_seq, m.group_id,
        (SELECT count(*) FROM grp g WHERE g.group_id = m.group_id AND g.stay_seq <> m.stay_seq) AS n_siblings
        FROM matches m WHERE m.group_id IS NOT NULL"""),
    "resolve_unit_hint": _with(["b"], "SELECT booking_seq, unit_hint, hinted_unit FROM b WHERE unit_hint IS NOT NULL"),
    "unit_lookup": _with(["s1", "units"], """SELECT s1.stay_seq, a.full_name AS by_code, f.abbreviation AS by_name FROM s1 LEFT JOIN units a ON a.abbreviation = s1.unit
        LEFT JOIN units f ON lower(trim(f.full_name)) = lower(trim(s1.unit))"""),
    "room_groups": _with(["grp", "s"], "SELECT group_id, matched_by, group_size, grp.stay_seq, unit, guest_name FROM grp JOIN s ON s.stay_seq = grp.stay_seq"),
    "room_moves": _with(["moves"], """SELECT name_key, move_date, earlier_unit, earlier_type, later_unit, later_type, max(earlier_seq) AS earlier_seq, max(later_seq) AS later_seq, count(*) AS n_moves
        FROM moves GROUP BY ALL"""),
    "move_notes": _with(["move_notes"], "SELECT * FROM move_notes"),
    "note_entries": _with(["entries"], "SELECT stay_seq, field_ord, entry_ord, entry FROM entries"),
    "note_mentions": _with(["mentions"], f"""SELECT stay_seq, {_FIELDS} AS source_field, entry_ord, date_ord, venue, resolved_date, time_text, weekday_text, is_ambiguous, flags, entry AS raw_text,
        CASE WHEN is_ambiguous THEN array_to_string(list_transform(occ, lambda d: CAST(d AS VARCHAR)), ',') END AS candidate_dates FROM mentions"""),
    "ambiguous_weekdays": _with(["checks"], "SELECT stay_seq, mention_ord, venue, settled AS settled_date, booking_seq, status FROM checks WHERE was_ambiguous"),
    "note_cross_check": _with(["checks", "checked"], f"""SELECT stay_seq, mention_ord, {_FIELDS} AS source_field, venue, mday AS mention_date, time_text, booking_seq, status, mismatch_kind FROM checks
        UNION ALL SELECT stay_seq, NULL, NULL, NULL, NULL, NULL, booking_seq, status, NULL FROM checked WHERE status = 'reservation_without_note'"""),
    "capacity": _with(["roster"], "SELECT stay_seq, guests_count AS actual_guests, max_guests FROM roster WHERE guests_count > max_guests"),
    "bed_request": _with(["roster"], "SELECT stay_seq, has_sofa_bed AS satisfied FROM roster WHERE bed_request AND category IS NOT NULL"),
    "pet_policy": _with(["roster"], "SELECT stay_seq, category FROM roster WHERE pet AND category <> 'Cabins'"),
    "perks": _with(["roster"], "SELECT stay_seq, consortium, breakfast, pet FROM roster WHERE consortium OR breakfast OR pet"),
    "duplicates": _with(["dups"], "SELECT stay_seq, confirmation_number, occurrences FROM dups"),
    "report_lines": _with(["lines"], "SELECT stay_seq, line_kind, severity, reasons, booking_seq, mention_ord, detail FROM lines"),
    "line_alternates": _with(["ranked", "matches", "blines", "s"], """SELECT r.booking_seq, m.stay_seq, r.stay_seq AS alternate_seq, s.guest_name AS alternate_name, round(r.score, 6) AS score
        FROM ranked r JOIN matches m USING (booking_seq) JOIN s ON s.stay_seq = r.stay_seq
        WHERE ((r.outcome = 'tied' AND r.is_top) OR (r.outcome = 'near_tie' AND r.top - r.score < 8)) AND r.stay_seq <> m.stay_seq
          AND booking_seq IN (SELECT booking_seq FROM blines WHERE reasons = 'ambiguous' OR contains(reasons, 'resolved_by_note'))"""),
    "incremental_load": _with(["printed"], f"""SELECT doc, CAST(sum(len(string_split(txt, ' '))) AS BIGINT) AS n_words, max(page) AS pages FROM ({PRINTED}) p GROUP BY doc"""),
    "incremental_report": _with(["heads"], """SELECT 'arrivals-' || lpad(CAST(stay_seq // 4294967296 AS VARCHAR), 8, '0') AS doc, stay_seq % 4294967296 AS rec_no, * EXCLUDE (stay_seq, group_id),
        CASE WHEN group_id IS NULL THEN '' ELSE 'arrivals-' || lpad(CAST(group_id // 4294967296 AS VARCHAR), 8, '0') || '/' || (group_id % 4294967296) END AS group_first FROM heads""", PARSED),
    "words_to_report": _with(["heads"], "SELECT * FROM heads", PARSED),
    "written_report": _with(["heads", "lines", "grp", "s", "s1"], f"""SELECT table_name, coalesce(strftime(arrival, '%Y-%m'), 'unknown') AS arrival_month, row_text FROM (
        SELECT 'report_header' AS table_name, stay_seq, {_cells(HEADER)} AS row_text FROM heads
        UNION ALL SELECT 'report_line', stay_seq, {_cells(["stay_seq", "line_kind", "severity", "reasons", "booking_seq", "mention_ord", "detail"])} FROM lines
        UNION ALL SELECT 'report_group', stay_seq, {_cells(["group_id", "matched_by", "group_size", "stay_seq", "unit", "guest_name"])} FROM grp JOIN s USING (stay_seq)
        ) t JOIN (SELECT stay_seq, arrival FROM s1) d USING (stay_seq)"""),
    "group_cells": _with(["grp", "s"], """SELECT group_id, cell, string_agg(unit, ', ' ORDER BY stay_seq) AS units FROM (
        SELECT group_id, stay_seq, unit, (row_number() OVER (PARTITION BY group_id ORDER BY stay_seq) - 1) // 2 AS cell FROM grp JOIN s USING (stay_seq) WHERE unit <> '') q
        GROUP BY group_id, cell"""),
    "report_headers": _with(["heads"], "SELECT * FROM heads"),
    "report_summary": _with(["heads", "moves", "grp"], """SELECT count(*) AS total, count(*) FILTER (severity = 3) AS red, count(*) FILTER (severity = 2) AS yellow,
        count(*) FILTER (severity = 1) AS blue, count(*) FILTER (severity = 0) AS green, (SELECT count(*) FROM moves) AS unit_moves,
        (SELECT count(DISTINCT group_id) FROM grp) AS group_bookings FROM heads"""),
    "report_page": _with(["heads"], """SELECT sorted_by, page, stay_seq, guest_name, severity FROM (
        SELECT *, row_number() OVER (PARTITION BY sorted_by ORDER BY CASE WHEN sorted_by = 'severity' THEN -severity END, CASE WHEN sorted_by = 'name' THEN lower(guest_name) END,
          is_duplicate, arrival NULLS LAST, stay_seq) - 1 AS nth, count(*) OVER (PARTITION BY sorted_by) AS total
        FROM heads, (VALUES ('severity'), ('name'), ('arrival')) o(sorted_by) WHERE severity IN (2, 3) AND contains(lower(guest_name), 'an')) h
      JOIN (VALUES ('severity', 1), ('severity', 7), ('severity', 1000000), ('name', 2), ('arrival', 2)) a(order_by, page) ON order_by = sorted_by
      WHERE nth // 10 = least(page, (total + 9) // 10) - 1"""),
    "note_profile": _with(["s1"], f"""SELECT stay_seq, right(confirmation_number, 4) AS confirmation_tail, length(guest_notes) AS guest_notes_length, length(reservation_notes) AS reservation_notes_length,
        length(comments_notes) AS comments_notes_length, regexp_matches({_all_notes}, '{_BED}') AS bed_request FROM s1"""),
    "display_fields": _with(["b"], r"""SELECT booking_seq, booking_time || ' PM' AS shown_time,
        CASE WHEN is_outside THEN 'Outside guest' ELSE coalesce(hinted_unit, trim(regexp_replace(unit_hint, '^[''\s,.\-]*s\b[\s,.\-]*', '', 'i')), '') END AS shown_unit FROM b"""),
    "classify_docs": _with(["printed", "b0"], """SELECT DISTINCT doc, 'arrivals' AS kind FROM printed
        UNION ALL SELECT DISTINCT 'export-' || CASE WHEN source_date = 'n/a' THEN 'undated' ELSE replace(replace(source_date, ',', ''), ' ', '-') END, 'bookings' FROM b0
        UNION ALL SELECT 'text-' || doc_id, NULL FROM documents"""),
    "lines": _with(["printed"], f"""SELECT doc, page, row_number() OVER (PARTITION BY doc, page ORDER BY slot, k) - 1 AS line_no, txt AS text FROM ({PRINTED}) q"""),
    "parse_stays": _with(["printed"], """SELECT doc, stay_seq % 1000 + 1 AS rec_no, page AS source_page, confirmation_number, guest_name, unit, unit_type, status, arrival_date,
        CASE WHEN departure_date = 'TBD' THEN '' ELSE departure_date END AS departure_date, guests_count, 0 AS guests_share, 'LEIS' AS rate_plan,
        guest_notes || CASE WHEN stay_seq % 7 = 1 AND guest_notes <> '' AND reservation_notes = '' AND comments_notes = '' THEN ' more of it' ELSE '' END AS guest_notes,
        reservation_notes || CASE WHEN stay_seq % 7 = 1 AND reservation_notes <> '' AND comments_notes = '' THEN ' more of it' ELSE '' END AS reservation_notes,
        comments_notes || CASE WHEN stay_seq % 7 = 1 AND comments_notes <> '' THEN chr(10) || chr(10) || 'more of it' ELSE '' END AS comments_notes,
        CASE WHEN stay_seq % 7 = 0 THEN '12 Quay Lane' ELSE '' END AS address, CASE WHEN stay_seq % 7 = 2 THEN 'NORTH WING' ELSE '' END AS last_stay_property,
        CASE WHEN stay_seq % 7 = 2 THEN '10' ELSE '' END AS lifetime_nights, CASE WHEN stay_seq % 7 = 2 THEN '4' ELSE '' END AS lifetime_stays,
        CASE WHEN stay_seq % 7 = 3 THEN 'Harbour Tours' ELSE '' END AS booking_agency, CASE WHEN stay_seq % 7 = 3 THEN '555' ELSE '' END AS iata,
        concat_ws(';', CASE WHEN stay_seq % 7 = 5 THEN 'unrecognized_row:''odd mark here''' END, CASE WHEN unit = '' THEN 'missing_room_name' END,
          CASE WHEN stay_seq // 1000 % 2 = 1 THEN 'count_mismatch: parsed ' || count(*) OVER (PARTITION BY doc) || ' vs report total ' || (count(*) OVER (PARTITION BY doc) + 1) END) AS flags FROM printed"""),
    "parse_bookings": _with(["b"], """SELECT 'export-' || CASE WHEN source_date = 'n/a' THEN 'undated' ELSE replace(replace(source_date, ',', ''), ' ', '-') END AS doc,
        row_number() OVER (PARTITION BY source_date ORDER BY booking_seq) AS rec_no, CASE WHEN source_date = 'n/a' THEN '' ELSE source_date END AS source_date, booking_time, party_size, guest_name,
        '(518) 555-' || lpad(CAST(booking_seq % 10000 AS VARCHAR), 4, '0') AS phone, notes_tags, venue, unit_hint, is_outside, CASE WHEN venue IS NULL THEN 'no_restaurant_detected' ELSE '' END AS flags FROM b"""),
}
