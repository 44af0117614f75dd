"""Parsing of timestamps in mixed notations into UTC microseconds.

``readings`` gives every valid reading of a value; which one a source means is settled by
:mod:`marketweave.operators.timestamp_mixture`. It is one Arrow-batched function: as nested column expressions the eight
notations outgrow what the JVM compiles.
"""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta
from functools import lru_cache
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

# Month names and abbreviations in English, Indonesian, German and Spanish.
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9,
    "october": 10, "november": 11, "december": 12, "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8,
    "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12,
    "januari": 1, "februari": 2, "maret": 3, "mei": 5, "juni": 6, "juli": 7, "agustus": 8, "oktober": 10, "desember": 12,
    "peb": 2, "agu": 8, "ags": 8, "agt": 8, "okt": 10, "nop": 11, "des": 12,
    "januar": 1, "jänner": 1, "februar": 2, "märz": 3, "maerz": 3, "mrz": 3, "mär": 3, "mai": 5, "dezember": 12, "dez": 12,
    "enero": 1, "febrero": 2, "marzo": 3, "abril": 4, "mayo": 5, "junio": 6, "julio": 7, "agosto": 8, "septiembre": 9,
    "setiembre": 9, "octubre": 10, "noviembre": 11, "diciembre": 12, "ene": 1, "abr": 4, "ago": 8, "dic": 12,
}
# Zone abbreviations in minutes east of Greenwich.
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "mez": 60, "mesz": 120,
    "eet": 120, "eest": 180, "msk": 180, "ist": 330, "wib": 420, "ict": 420, "wita": 480, "sgt": 480, "hkt": 480, "myt": 480,
    "pht": 480, "awst": 480, "wit": 540, "jst": 540, "kst": 540, "acst": 570, "acdt": 630, "aest": 600, "aedt": 660,
    "nzst": 720, "nzdt": 780, "ast": -240, "adt": -180, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420,
    "mdt": -360, "pst": -480, "pdt": -420, "brt": -180, "art": -180,
}
# Abbreviations that mean something else to outlets of some zones.
ABBREVIATIONS_BY_ZONE = {
    ("ist", "Europe/Dublin"): 60, ("ist", "Asia/Jerusalem"): 120, ("cst", "Asia/Shanghai"): 480, ("cst", "Asia/Taipei"): 480,
    ("bst", "Asia/Dhaka"): 360, ("est", "Australia/Sydney"): 600, ("edt", "Australia/Sydney"): 660,
    ("est", "Australia/Melbourne"): 600, ("edt", "Australia/Melbourne"): 660, ("ast", "Asia/Riyadh"): 180,
}

_TIME = r"(\d{1,2})[:.](\d{2})(?:[:.](\d{2})(?:[.,](\d{1,9}))?)?"
_ZONE = r"(?:(z|[+-]\d{2}:?\d{2}|[+-]\d{2}|[^\W\d_]{2,5})?(?:\s*\[([a-z_+-]+(?:/[a-z0-9_+-]+)*)\])?)"
_TAIL = r"\s*(?:(?:uhr|hrs|h)\b)?\s*([ap]\.?m\b\.?)?\s*" + _ZONE + "$"
_YMD = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?:t|,?\s+)" + _TIME + _TAIL
_COMPACT = r"^(\d{4})(\d{2})(\d{2})(?:t|\s|(?=\d{4}$)|(?=\d{6}$))(\d{2})(\d{2})(?:(\d{2})(?:[.,](\d{1,9}))?)?" + _TAIL
_NUMERIC = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})(?:t|,?\s+)(?:at\s+|um\s+|pukul\s+)?" + _TIME + _TAIL
_DAY_NAME = (
    r"^(?:[^\W\d_]+\.?,\s*)?(\d{1,2})(?:\.|st|nd|rd|th)?(?:\s+de)?[\s-]+([^\W\d_]+)\.?(?:\s+del?)?[\s,-]+(\d{4})(?:,?\s+|t)"
    r"(?:at\s+|um\s+|a\s+las\s+|pukul\s+|-\s+)?" + _TIME + _TAIL
)
_NAME_DAY = r"^(?:[^\W\d_]+\.?,\s*)?([^\W\d_]+)\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4}),?\s+(?:at\s+)?" + _TIME + _TAIL

# Tried in this order; the letters name the first three groups.
_NOTATIONS = (
    ("ymd", "ymd", re.compile(_YMD)), ("numeric", "dmy", re.compile(_NUMERIC)), ("day_name", "dmy", re.compile(_DAY_NAME)),
    ("name_day", "mdy", re.compile(_NAME_DAY)), ("compact", "ymd", re.compile(_COMPACT)),
)
_EPOCH = re.compile(r"(\d{10})(?:\.(\d{1,6}))?$|(\d{13})$|(\d{16})$")

US = 1_000_000
_DAY_US = 86_400 * US
_EPOCH_ORDINAL = date(1970, 1, 1).toordinal()


@lru_cache(maxsize=1024)
def _zone(name: str | None) -> ZoneInfo | None:
    """An IANA zone by its name in any case, None if unknown."""
    if not name:
        return None
    spelled = "/".join("_".join(w[:1].upper() + w[1:] for w in part.split("_")) for part in name.split("/"))
    for x in (name, spelled):
        try:
            return ZoneInfo(x)
        except (KeyError, ValueError, OSError):
            pass
    return None


def local_to_utc(days: int, clock_us: int, zone: ZoneInfo) -> int:
    """A local time as UTC microseconds: the earlier of two, or by the offset before the change if it is skipped."""
    local = datetime.fromordinal(days + _EPOCH_ORDINAL) + timedelta(microseconds=clock_us)
    offset = local.replace(tzinfo=zone, fold=0).utcoffset()
    return days * _DAY_US + clock_us - offset // timedelta(microseconds=1)


def _days(y: str, m: str, d: str) -> int | None:
    try:
        return date(int(y), int(m), int(d)).toordinal() - _EPOCH_ORDINAL
    except ValueError:
        return None


def _clock(hour: str, minute: str, second: str | None, fraction: str | None, half: str | None) -> int | None:
    """Microseconds since midnight, None where no clock shows the time; parts not written are zero."""
    h, m, s = int(hour), int(minute), int(second or 0)
    if half:
        if not 1 <= h <= 12:
            return None
        h = h % 12 + (12 if half[0] == "p" else 0)
    if h > 23 or m > 59 or s > 59:
        return None
    return ((h * 60 + m) * 60 + s) * US + int((fraction or "0").ljust(6, "0")[:6])


def _offset_us(written: str, outlet_zone: str | None) -> int | None:
    """Microseconds east of Greenwich of a written offset or abbreviation, None if it is neither."""
    if written[0] in "+-":
        digits = written[1:].replace(":", "")
        h, m = int(digits[:2]), int(digits[2:] or 0)
        return None if h > 18 or m > 59 else (h * 60 + m) * (-1 if written[0] == "-" else 1) * 60 * US
    minutes = ABBREVIATIONS_BY_ZONE.get((written, outlet_zone), ABBREVIATIONS.get(written))
    return None if minutes is None else minutes * 60 * US


def parse(value: str | None, outlet_zone: str | None) -> tuple[str | None, int | None, int | None]:
    """Family of the notation, and UTC microseconds of the first and of the other reading.

    The other reading is month before day of an all-number date, and None for anything else. Null, blank, date-only, unknown
    and impossible values have no reading. A value without zone is read in the outlet's zone, and has no reading without one.
    """
    v = value.strip().lower() if isinstance(value, str) else ""
    if not v or not any(c.isdigit() for c in v):
        return None, None, None
    if m := _EPOCH.match(v):
        s, f, ms, us = m.groups()
        n = int(s) * US + int((f or "0").ljust(6, "0")) if s else int(ms) * 1000 if ms else int(us)
        return "epoch", n, None
    for name, order, pattern in _NOTATIONS:
        m = pattern.match(v)
        if not m:
            continue
        hh, mi, ss, ff, half, written, iana = m.groups()[3:]
        part = dict(zip(order, m.groups()[:3]))
        clock = _clock(hh, mi, ss, ff, half)
        offset = _offset_us(written, outlet_zone) if written else None
        zone = None if written else _zone(iana) if iana else _zone(outlet_zone)
        if clock is None or (written and offset is None) or (not written and zone is None):
            return name, None, None

        def instant(days: int | None) -> int | None:
            if days is None:
                return None
            return days * _DAY_US + clock - offset if written else local_to_utc(days, clock, zone)

        if name in ("day_name", "name_day"):
            return name, instant(_days(part["y"], MONTHS.get(part["m"], 0), part["d"])), None
        other = instant(_days(part["y"], part["d"], part["m"])) if name == "numeric" else None
        return name, instant(_days(part["y"], part["m"], part["d"])), other
    return None, None, None


def _batch(value: pd.Series, outlet_zone: pd.Series) -> pd.DataFrame:
    """Readings of each value; what occurs several times in a batch is parsed once."""
    at, pairs = pd.MultiIndex.from_arrays([value, outlet_zone]).factorize()
    told = [parse(v, z if isinstance(z, str) else None) for v, z in pairs]
    out = pd.DataFrame([told[i] for i in at], columns=["family", "main", "other"], dtype=object)
    return out.astype({"main": "Int64", "other": "Int64"})


def readings(value: Column, outlet_zone: Column) -> Column:
    """Struct of family string, main bigint and other bigint, as :func:`parse` gives them."""

    @pandas_udf("family string, main bigint, other bigint")
    def batch(value: pd.Series, outlet_zone: pd.Series) -> pd.DataFrame:
        return _batch(value, outlet_zone)

    return batch(value, outlet_zone)
