"""Literal stays, bookings and words for the tests."""

from pyspark.sql import Row

from workload.derive import SETTINGS

STAY = ("stay_seq bigint, confirmation_number string, guest_name string, unit string, unit_type string, status string, "
        "arrival_date string, departure_date string, guests_count int, guest_notes string, reservation_notes string, "
        "comments_notes string")
BOOKING = ("booking_seq bigint, source_date string, booking_time string, party_size int, guest_name string, "
           "notes_tags string")


class Case:
    """Collects stays and bookings under readable labels."""

    def __init__(self):
        self.stays, self.bookings, self.stay_no, self.booking_no = [], [], {}, {}

    def stay(self, label, name, arrival="07/10/2026", departure="07/13/2026", unit="ALDER", unit_type="T0",
             guests=2, conf=None, guest="", reservation="", comments=""):
        n = len(self.stays)
        self.stay_no[label] = n
        self.stays.append((n, f"C{n}" if conf is None else conf, name, unit, unit_type, "Reserved", arrival, departure,
                           guests, guest, reservation, comments))

    def book(self, label, name, day="Jul 10, 2026", time="7:00", party=2, tags="lantern ALDER"):
        n = len(self.bookings)
        self.booking_no[label] = n
        self.bookings.append((n, day, time, party, name, tags))

    def frames(self, spark):
        return spark.createDataFrame(self.stays, STAY), spark.createDataFrame(self.bookings, BOOKING)


def words(spark, rows):
    """rows: (doc, page, top, [(x0, text), ...]); texts are split into words 6 points apart."""
    out = []
    for doc, page, top, runs in rows:
        for x, text in runs:
            for i, w in enumerate(text.split(" ")):
                out.append(Row(doc=doc, page=page, text=w, x0=float(x + 6 * i), x1=float(x + 6 * i + 5),
                               top=float(top), bottom=float(top + 10)))
    return spark.createDataFrame(out)


__all__ = ["Case", "SETTINGS", "words"]
