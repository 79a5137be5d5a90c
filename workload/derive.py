"""Stays, bookings and configuration derived from the given `orders` and `events`.

The rules are plain SQL that Spark and DuckDB read alike; `weekday` is the only word
that differs.  The oracle queries start from the same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stayledger.settings import Settings, Unit

SURNAMES = "Okafor,Lindqvist,Moreau,Tanaka,Petrovic,Castellan,Ibarra,Novakova,Brightwell,Haddad,Sandoval,Fenwick,Amaro,Delacourt,Vossler,Quill"
FIRSTS = "Maren,Tobias,Ilse,Rafael,Noor,Jonas,Petra,Emeka,Lucia,Anton,Rosalind,T.K.,Hugo,Dalia,Wim,Zora"
CODES = "ALDER,ASPEN,BEECH,BIRCH,CEDAR,HAZEL,LARCH,MAPLE,PINE,ROWAN,RDGOAK,STELM"
NAMES = "Alder,Aspen,Beech,Birch,Cedar,Hazel,Larch,Maple,Pine,Rowan,Ridge Oak,St. Elm"
WEEKDAYS = "MONDAY,TUESDAY,WEDNESDAY,THURSDAY,FRIDAY,SATURDAY,SUNDAY"
MONTH_NAMES = "January,February,March,April,May,June,July,August,September,October,November,December"
MONTHS = "Jan,Feb,Mar,Apr,May,Jun,Jul,Aug,Sep,Oct,Nov,Dec"
CAPACITY = {0: 5, 4: 4, 1: 3, 2: 3, 6: 3, 7: 3, 11: None}
SOFA = (0, 1, 2, 6, 7)


def _category(i: int) -> str:
    return "Cabins" if i < 6 else "Lakeside" if i < 9 else "Lodge"


SETTINGS = Settings(
    venues=(("lantern", "Lantern"), ("quarry", "Quarry")),
    units=tuple(Unit(c, n, _category(i), f"T{i % 5}", CAPACITY.get(i, 2), i in SOFA)
                for i, (c, n) in enumerate(zip(CODES.split(","), NAMES.split(",")))),
    misspellings=(("ALDAR", "ALDER"), ("LARTCH", "LARCH")),
    shorthand=("rq", "wl", "tbc"),
    non_unit_terms=("ATRIUM", "BOATHOUSE", "BOAT", "TERRACE"),
    pet_category="Cabins",
)


def _pick(words: str, index: str) -> str:
    return f"split_part('{words}', ',', CAST(({index}) AS INT) + 1)"


def _mdy(d: str) -> str:
    return (f"lpad(CAST(month({d}) AS STRING), 2, '0') || '/' || lpad(CAST(day({d}) AS STRING), 2, '0')"
            f" || '/' || CAST(year({d}) AS STRING)")


def _md(d: str) -> str:
    return f"CAST(month({d}) AS STRING) || '/' || CAST(day({d}) AS STRING)"


BASE = f"""SELECT k, a, d, n1,
  {_pick(SURNAMES, '(c*7+3)%16')} AS sn, {_pick(FIRSTS, 'floor(c/16)%16')} AS fn
FROM (SELECT k, c, a, a + CAST(CASE WHEN k%17=0 THEN 12 ELSE 1+k%5 END AS INT) AS d, a + CAST(k%3 AS INT) AS n1
      FROM (SELECT o_orderkey AS k, o_custkey AS c, CAST(o_orderdate AS DATE) AS a FROM {{orders}}) q0) q1"""


def stays_sql(weekday: str) -> str:
    return f"""SELECT k AS stay_seq,
  'C' || CAST(CASE WHEN k>0 AND k%97=0 THEN k-1 ELSE k END AS STRING) AS confirmation_number,
  sn || ', ' || fn || CASE WHEN k%13=0 THEN ' K' ELSE '' END AS guest_name,
  CASE WHEN k%29=0 THEN '' ELSE {_pick(CODES, 'k%12')} END AS unit,
  'T' || CAST(k%12%5 AS STRING) AS unit_type,
  'Reserved' AS status,
  {_mdy('a')} AS arrival_date,
  CASE WHEN k%211=0 THEN 'TBD' ELSE {_mdy('d')} END AS departure_date,
  CASE WHEN k%31=0 THEN NULL ELSE CAST(1+k%5 AS INT) END AS guests_count,
  CASE k%9 WHEN 1 THEN 'Virtuoso client, fruit plate in the unit' WHEN 2 THEN 'would like a roll-away'
    WHEN 3 THEN 'pet friendly unit, one terrier' ELSE '' END AS guest_notes,
  CASE k%8 WHEN 0 THEN 'rate: breakfast incl. for two'
    WHEN 1 THEN 'second visit this year / ' || {_pick(WEEKDAYS, weekday.format('n1'))} || ' LANTERN 7PM'
    WHEN 2 THEN 'quarry on ' || {_pick(MONTH_NAMES, 'month(n1)-1')} || ' ' || CAST(day(n1) AS STRING) || 'th 8:15 pm' ELSE '' END AS reservation_notes,
  CASE k%6 WHEN 0 THEN 'supper at Lantern ' || {_md('n1')} || ', 7PM'
    WHEN 1 THEN 'Quarry ' || {_md('a')} || ' 6:30PM, then Lantern ' || {_md('n1')} || ' 8pm'
    WHEN 2 THEN 'both nights quarry ' || {_md('a')} || ' & ' || CAST(day(n1) AS STRING) || ' 7 pm'
    WHEN 3 THEN 'Lantern ' || {_md('a')} || '\n\n' || 'QUARRY ' || {_md('n1')} || ' & ' || {_md('a')} || ' at 8:00 PM' ELSE '' END AS comments_notes
FROM ({BASE}) base"""


BOOKINGS = f"""SELECT e AS booking_seq,
  CASE WHEN e%101=0 THEN 'n/a' ELSE {_pick(MONTHS, 'month(n1)-1')} || ' ' || CAST(day(n1) AS STRING) || ', ' || CAST(year(n1) AS STRING) END AS source_date,
  CASE e%4 WHEN 1 THEN '6:30' WHEN 2 THEN '8:00' ELSE '7:00' END AS booking_time,
  CAST(1 + e%5 + CASE WHEN e%11=0 THEN 1 ELSE 0 END AS INT) AS party_size,
  CASE e%7 WHEN 0 THEN upper(sn) WHEN 1 THEN sn || ', ' || fn
    WHEN 2 THEN fn || ' ' || substr(sn, 1, 3) || substr(sn, 5)
    WHEN 3 THEN {_pick(FIRSTS, 'e%16')} || ' ' || sn ELSE fn || ' ' || sn END AS guest_name,
  CASE e%6 WHEN 0 THEN 'lantern ' || {_pick(CODES, 'k%12')}
    WHEN 1 THEN 'Quarry''s ' || {_pick(NAMES, 'k%12')} || ' RQ'
    WHEN 2 THEN 'lantern'
    WHEN 3 THEN 'lantern- ' || lower({_pick(NAMES, 'k%12')})
    WHEN 4 THEN 'quarry ' || {_pick(CODES, '(k+5)%12')}
    ELSE CASE WHEN e%5=0 THEN 'lantern off property' ELSE 'no table note' END END AS notes_tags
FROM (SELECT event_id AS e, base.* FROM {{events}} ev JOIN ({BASE}) base ON base.k = ev.event_id) eb"""


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The columns of a given table.  A table here is one small file, which Spark reads in one task; its rows are dealt out
    before text is made of them."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), columns[0])


def stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    return spark.sql(stays_sql("weekday({})"), orders=orders)


def bookings(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    events = _table(spark, sf_dir, "events", "event_id")
    return spark.sql(BOOKINGS, orders=orders, events=events)


def duck_stays() -> str:
    return stays_sql("isodow({})-1").format(orders="orders")


def duck_bookings() -> str:
    return BOOKINGS.format(orders="orders", events="events")
