"""Problem 5: mixed timestamp formats and time zones, normalised to UTC.

Every format is one alternative of a single compiled expression whose groups
carry the same names in all alternatives.  A value is matched once; its parts
are validated against the calendar, and the instant is assembled by integer day
arithmetic.  Only the offset of a local time is looked up in the zone database.

Rules: an offset, zone abbreviation or zone name in the text holds; otherwise a
value is local time of the source, or UTC if the source has no zone.  A local
time that occurs twice means its first occurrence, one that was skipped is read
with the offset before the change.  Missing parts are zero, digits beyond
microseconds are dropped.  Bare numbers are epoch seconds, or milliseconds from
``MILLIS_FROM`` on.  Spans count back from the fetch time, days have 24 hours.

Defined results: null, blank or unreadable values, impossible dates and spans
without a fetch time give no instant; an unknown zone name counts as none; an
unknown day/month order counts as day first; surrounding space and letter case
do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime
from functools import lru_cache
from zoneinfo import ZoneInfo

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month names and their usual short forms in the languages that occur.
_MONTHS = (
    "january jan januar jänner janvier janv enero ene janeiro",
    "february feb februar février fevrier févr fevr febrero fevereiro fev",
    "march mar märz maerz mrz mars marzo março marco",
    "april apr avril avr abril abr",
    "may mai mayo maio",
    "june jun juni juin junio junho",
    "july jul juli juillet juil julio julho",
    "august aug août aout agosto ago",
    "september sep sept septembre septiembre setiembre setembro set",
    "october oct oktober okt octobre octubre outubro out",
    "november nov novembre noviembre novembro",
    "december dec dezember dez décembre decembre déc diciembre dic dezembro",
)
MONTHS = {name: k for k, names in enumerate(_MONTHS, 1) for name in names.split()}

# Seconds of the span units.
_UNITS = {
    1: "second seconds sec secs sekunde sekunden seconde secondes segundo segundos",
    60: "minute minutes min mins minuten minuto minutos",
    3600: "hour hours hr hrs stunde stunden heure heures hora horas",
    86400: "day days tag tage tagen jour jours día días dia dias",
    604800: "week weeks woche wochen semaine semaines semana semanas",
}
UNITS = {name: s for s, names in _UNITS.items() for name in names.split()}

# Zone abbreviations in minutes east of UTC.
ZONES = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "mez": 60, "cest": 120, "mesz": 120, "eet": 120, "eest": 180, "msk": 180,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "brt": -180, "brst": -120, "art": -180,
    "jst": 540, "kst": 540, "ist": 330,
}

MILLIS_FROM = 100_000_000_000
_EARLIEST, _LATEST = -62_135_596_800, 253_402_300_799  # years 1 to 9999

_DATE = r"(?P<y>\d{4})"
_CLOCK = r"(?P<H>\d{1,2}):(?P<M>\d{2})(?::(?P<S>\d{2})(?:[.,](?P<f>\d+))?)?"
_NAMED_CLOCK = r"(?P<H>\d{1,2})[:h](?P<M>\d{2})?(?::(?P<S>\d{2})(?:[.,](?P<f>\d+))?)?(?:\s*uhr)?(?:\s*(?P<ap>[ap])\.?m\.?)?"
_OFFSET = r"(?P<sign>[+\-−])(?P<oh>\d{2}):?(?P<om>\d{2})?"
_ZONE = rf"(?:\s*(?:(?:utc|gmt)?{_OFFSET}|(?P<zone>[a-z]{{1,5}})))?(?:\s*\[(?P<region>[\w+\-/]+)\])?"
_MONTH = r"(?P<mon>" + "|".join(sorted(map(regex.escape, MONTHS), key=len, reverse=True)) + r")\.?"
_UNIT = r"(?P<unit>" + "|".join(sorted(map(regex.escape, UNITS), key=len, reverse=True)) + r")"
_WEEKDAY = r"(?:[^\W\d_]+\.?,?\s+)?"
_JOIN = r"(?:\s*,?\s*(?:às|as|à|a las|at|um|,)?\s*)"

FORMATS = (
    rf"{_DATE}-(?P<m>\d{{1,2}})-(?P<d>\d{{1,2}})(?:(?:t|\s+){_CLOCK})?{_ZONE}",
    rf"{_DATE}/(?P<m>\d{{1,2}})/(?P<d>\d{{1,2}})(?:\s+{_CLOCK})?{_ZONE}",
    rf"{_DATE}(?P<m>\d{{2}})(?P<d>\d{{2}})t(?P<H>\d{{2}})(?P<M>\d{{2}})(?P<S>\d{{2}})?(?:[.,](?P<f>\d+))?{_ZONE}",
    rf"(?P<n1>\d{{1,2}})(?P<sep>[/.\-])(?P<n2>\d{{1,2}})(?P=sep){_DATE}(?:\s*,?\s+{_CLOCK}(?:\s*(?P<ap>[ap])\.?m\.?)?)?{_ZONE}",
    rf"{_WEEKDAY}(?P<d>\d{{1,2}})(?:\.|st|nd|rd|th|er)?\s+(?:de\s+)?{_MONTH}\s+(?:de\s+)?{_DATE}(?:{_JOIN}{_NAMED_CLOCK})?{_ZONE}",
    rf"{_WEEKDAY}{_MONTH}\s+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s+{_DATE}(?:{_JOIN}{_NAMED_CLOCK})?{_ZONE}",
    rf"(?P<count>\d+)\s+{_UNIT}\s+ago",
    rf"(?:vor|il y a|hace|há|ha)\s+(?P<count>\d+)\s+{_UNIT}",
    r"(?P<epoch>-?\d+)(?:\.(?P<f>\d+))?",
)
PATTERN = regex.compile("|".join(f"(?:{f})" for f in FORMATS))


def days_from_civil(y: int, m: int, d: int) -> int:
    """Days since 1970-01-01 in the proleptic Gregorian calendar."""
    y -= m <= 2
    era = y // 400
    yoe = y - era * 400
    doy = (153 * (m + (-3 if m > 2 else 9)) + 2) // 5 + d - 1
    return era * 146097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719468


def month_days(y: int, m: int) -> int:
    return 29 if m == 2 and y % 4 == 0 and (y % 100 != 0 or y % 400 == 0) else (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[m - 1]


@lru_cache(512)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except Exception:  # noqa: BLE001 - any malformed name is no zone
        return None


def _offset(zone: ZoneInfo, y: int, m: int, d: int, hour: int, minute: int, second: int) -> int:
    """Seconds east of UTC: of the first of two occurrences, or before the change that skips the time."""
    return int(datetime(y, m, d, hour, minute, second, tzinfo=zone, fold=0).utcoffset().total_seconds())


def _micros(fraction: str | None) -> int:
    return int(f"{fraction[:6]:0<6}") if fraction else 0


def to_utc_micros(value: str | None, zone_name: str | None = None, date_order: str | None = None, fetched_micros: int | None = None) -> int | None:
    """The instant that a text names, in microseconds since 1970-01-01 UTC."""
    if value is None:
        return None
    match = PATTERN.fullmatch(value.strip().lower())
    if not match:
        return None
    g = match.groupdict()
    if g["epoch"]:
        number = int(g["epoch"])
        if abs(number) >= MILLIS_FROM:
            seconds, micros = number // 1000, number % 1000 * 1000
        else:
            seconds, micros = number, _micros(g["f"])
        return seconds * 1_000_000 + micros if _EARLIEST <= seconds <= _LATEST else None
    if g["count"]:
        return None if fetched_micros is None else fetched_micros - int(g["count"]) * UNITS[g["unit"]] * 1_000_000
    y = int(g["y"])
    if g["n1"]:
        first, second = int(g["n1"]), int(g["n2"])
        d, m = (second, first) if date_order == "mdy" else (first, second)
    else:
        d, m = int(g["d"]), MONTHS[g["mon"]] if g["mon"] else int(g["m"])
    if not (1 <= y and 1 <= m <= 12 and 1 <= d <= month_days(y, m)):
        return None
    hour, minute, sec = int(g["H"] or 0), int(g["M"] or 0), int(g["S"] or 0)
    if g["ap"]:
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + (12 if g["ap"] == "p" else 0)
    if hour > 23 or minute > 59 or sec > 59:
        return None
    if g["sign"]:
        east = (int(g["oh"]) * 60 + int(g["om"] or 0)) * (60 if g["sign"] == "+" else -60)
    elif g["zone"]:
        if g["zone"] not in ZONES:
            return None
        east = ZONES[g["zone"]] * 60
    else:
        region = match.span("region")
        named = value.strip()[region[0] : region[1]] if region[0] >= 0 else zone_name
        zone = _zone(named) if named else None
        east = _offset(zone, y, m, d, hour, minute, sec) if zone else 0
    return ((days_from_civil(y, m, d) * 24 + hour) * 60 + minute) * 60_000_000 + (sec - east) * 1_000_000 + _micros(g["f"])


def _normaliser(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        cols = [batch.column(c).to_pylist() for c in ("value", "zone", "date_order", "fetched")]
        found = [to_utc_micros(*row) for row in zip(*cols, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("field"), pa.array(found, pa.int64())], names=["id", "field", "utc_micros"])


def normalise(values: DataFrame) -> DataFrame:
    """(id, field, utc_micros) of (id, field, value, zone, date_order, fetched), one row per value that names an instant.

    ``fetched`` is the fetch time in microseconds since 1970-01-01 UTC.
    """
    values = values.where("value is not null").select("id", "field", "value", "zone", "date_order", "fetched")
    return values.mapInArrow(_normaliser, "id long, field string, utc_micros long").where("utc_micros is not null")


def ntz_micros(c: Column) -> Column:
    """Microseconds of a timestamp that is UTC without a zone."""
    return F.unix_micros(F.to_utc_timestamp(c.cast("timestamp"), F.current_timezone()))


def article_times(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """(raw_id, field, utc_micros) of both date fields of raw articles."""
    zones = sources.where("slug is not null").groupBy(F.col("slug").alias("source_slug")).agg(F.first(F.col("config")["timezone"], True).alias("zone"), F.first(F.col("config")["date_order"], True).alias("date_order"))
    fields = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("published_at", "updated_at")))
    rows = articles.select("raw_id", "source_slug", ntz_micros(F.col("fetched_at")).alias("fetched"), F.explode(fields).alias("v"))
    joined = rows.where("v.value is not null").join(zones, "source_slug", "left")
    return normalise(joined.select(F.col("raw_id").alias("id"), "v.field", "v.value", "zone", "date_order", "fetched")).withColumnRenamed("id", "raw_id")
