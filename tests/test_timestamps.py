from datetime import datetime, timezone

import pytest

from newsloom.operators import timestamps as ts


def utc(*a):
    return int((datetime(*a, tzinfo=timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds() * 1_000_000)


FETCHED = utc(2025, 1, 10, 12)


@pytest.mark.parametrize(
    ("value", "zone", "order", "want"),
    [
        ("2024-10-27T02:30", "Europe/Berlin", None, utc(2024, 10, 27, 0, 30)),  # the first of two
        ("2024-03-31T02:30", "Europe/Berlin", None, utc(2024, 3, 31, 1, 30)),  # skipped: offset before the change
        ("2024-11-03 01:30:00", "America/New_York", None, utc(2024, 11, 3, 5, 30)),
        ("Fri, 31 Jan 2025 21:39:35 GMT", "Asia/Tokyo", None, utc(2025, 1, 31, 21, 39, 35)),
        ("Mon, 21 Oct 2024 08:18:23 -0300", None, None, utc(2024, 10, 21, 11, 18, 23)),
        ("03/10/2024 01:20", None, "mdy", utc(2024, 3, 10, 1, 20)),
        ("03/10/2024 01:20", None, "dmy", utc(2024, 10, 3, 1, 20)),
        ("2024-10-19", "America/Sao_Paulo", None, utc(2024, 10, 19, 3)),
        ("2024-10-20T09:18:40.942462641Z", None, None, utc(2024, 10, 20, 9, 18, 40) + 942462),
        ("2024-10-19T18:26:07+05:30[Asia/Kolkata]", None, None, utc(2024, 10, 19, 12, 56, 7)),
        (" 2024-10-19t13:04:20z ", "Asia/Tokyo", None, utc(2024, 10, 19, 13, 4, 20)),
        ("20241026T051112Z", None, None, utc(2024, 10, 26, 5, 11, 12)),
        ("October 20, 2024 12:02 AM", None, None, utc(2024, 10, 20, 0, 2)),
        ("March 31, 2024 12:08 PM", None, None, utc(2024, 3, 31, 12, 8)),
        ("18. März 2024, 19:56 Uhr", "Europe/Berlin", None, utc(2024, 3, 18, 18, 56)),
        ("21 octobre 2024 à 05h00", "Europe/Paris", None, utc(2024, 10, 21, 3)),
        ("2 de março de 2025 às 00h44", None, None, utc(2025, 3, 2, 0, 44)),
        ("1 de noviembre de 2024, 00:34", None, None, utc(2024, 11, 1, 0, 34)),
        ("2024-10-20 18:16:30 CDT", None, None, utc(2024, 10, 20, 23, 16, 30)),
        ("2024-09-10 09:06:58 BST", None, None, utc(2024, 9, 10, 8, 6, 58)),
        ("1729306906", None, None, 1729306906_000_000),
        ("1729483050343", None, None, 1729483050343_000),
        ("vor 3 Stunden", None, None, FETCHED - 3 * 3600_000_000),
        ("il y a 2 jours", None, None, FETCHED - 2 * 86400_000_000),
        ("há 8 minutos", None, None, FETCHED - 480_000_000),
        ("2024-02-29 00:00:00", None, None, utc(2024, 2, 29)),
        ("2024-10-19 10:00:00", "No/Where", None, utc(2024, 10, 19, 10)),
        ("2023-02-29", None, None, None), ("32/13/2025", None, "dmy", None), ("N/A", None, None, None), ("", None, None, None), ("  ", None, None, None), (None, None, None, None), ("2024-10-19 25:00:00", None, None, None), ("x" * 100_000, None, None, None),
    ],
)
def test_to_utc_micros(value, zone, order, want):
    assert ts.to_utc_micros(value, zone, order, FETCHED) == want


def test_days_from_civil():
    for y, m, d in ((1970, 1, 1), (2000, 2, 29), (1969, 12, 31), (2100, 3, 1), (1, 1, 1)):
        assert ts.days_from_civil(y, m, d) == (datetime(y, m, d) - datetime(1970, 1, 1)).days


def test_article_times(spark):
    rows = [(1, "a", datetime(2025, 1, 10, 12), "2024-10-19 10:00:00", None, "x"), (2, None, None, "2 hours ago", "2024-10-19", "y"), (3, "b", datetime(2025, 1, 10, 12), "1 hour ago", "TBC", "z")]
    items = spark.createDataFrame(rows, "raw_id long, source_slug string, fetched_at timestamp_ntz, published_at string, updated_at string, zone string")
    sources = spark.createDataFrame([("a", {"timezone": "Asia/Tokyo", "date_order": "dmy"}), ("b", None), (None, None), ("a", {"timezone": "Asia/Tokyo"})], "slug string, config map<string,string>")
    got = {(r.raw_id, r.field): r.utc_micros for r in ts.article_times(items, sources).collect()}
    assert got == {(1, "published_at"): utc(2024, 10, 19, 1), (2, "updated_at"): utc(2024, 10, 19), (3, "published_at"): utc(2025, 1, 10, 11)}
    assert ts.article_times(items.limit(0), sources).count() == 0
