"""Dates of the standard, Julian dates, epochs and time systems."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MJD_ZERO = 2400000.5
_ISO = r"^([+-]?\d{4,})-(\d{2})-(\d{2})(?:[T ](\d{2}):(\d{2}):(\d{2})(\.\d+)?)?$"
_OLD = r"^(\d{2})/(\d{2})/(\d{2})$"


def parse(text: Column) -> Column:
    """A struct (year, month, day, hour, minute, second) from an ISO date, or from dd/mm/yy in 19yy.

    Null if the form or a part is wrong; second 60 is a leap second and allowed.
    """
    t = F.trim(text)
    part = lambda n: F.regexp_extract(t, _ISO, n)
    old = lambda n: F.regexp_extract(t, _OLD, n)
    is_old = t.rlike(_OLD)
    year = F.when(is_old, 1900 + old(3).try_cast("int")).otherwise(part(1).try_cast("int"))
    month = F.when(is_old, old(2).try_cast("int")).otherwise(part(2).try_cast("int"))
    day = F.when(is_old, old(1).try_cast("int")).otherwise(part(3).try_cast("int"))
    timed = part(4) != ""
    clock = lambda n: F.when(timed, part(n).try_cast("int")).otherwise(0)
    second = F.when(timed, F.concat(part(6), part(7)).try_cast("double")).otherwise(F.lit(0.0))
    good = (t.rlike(_ISO) | is_old) & year.isNotNull() & month.between(1, 12) & day.between(1, month_days(year, month)) & clock(4).between(0, 23) & clock(5).between(0, 59) & (second < 61)
    made = F.struct(year.alias("year"), month.alias("month"), day.alias("day"), clock(4).alias("hour"), clock(5).alias("minute"), second.alias("second"))
    return F.when(good, made)


def leap(year: Column) -> Column:
    """Whether a year of the Gregorian calendar is a leap year."""
    return (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))


def month_days(year: Column, month: Column) -> Column:
    """How many days a month has."""
    return F.when(month == 2, F.when(leap(year), 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)


def format_date(d: Column) -> Column:
    """The ISO form; milliseconds only where there are any; years outside 0 to 9999 signed, of five digits."""
    year = F.when(d["year"].between(0, 9999), F.lpad(d["year"].cast("string"), 4, "0")).otherwise(
        F.concat(F.when(d["year"] < 0, "-").otherwise("+"), F.lpad(F.abs(d["year"]).cast("string"), F.greatest(F.lit(5), F.length(F.abs(d["year"]).cast("string"))), F.lit("0")))
    )
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    whole = F.floor(d["second"]).cast("int")
    ms = F.least(F.lit(999), F.round((d["second"] - whole) * 1000).cast("int"))
    tail = F.when(ms > 0, F.concat(F.lit("."), F.lpad(ms.cast("string"), 3, "0"))).otherwise("")
    return F.concat(year, F.lit("-"), two(d["month"]), F.lit("-"), two(d["day"]), F.lit("T"), two(d["hour"]), F.lit(":"), two(d["minute"]), F.lit(":"), two(whole), tail)


def _quotient(a: Column, b: int) -> Column:
    return F.floor(a / F.lit(b)).cast("bigint")


def day_number(year: Column, month: Column, day: Column) -> Column:
    """The Julian day number of noon of a Gregorian date."""
    early = F.when(month <= 2, 1).otherwise(0)
    y, m = year.cast("bigint") + 4800 - early, month.cast("bigint") + 12 * early - 3
    return day + _quotient(153 * m + 2, 5) + 365 * y + _quotient(y, 4) - _quotient(y, 100) + _quotient(y, 400) - 32045


def julian_date(d: Column) -> Column:
    """The Julian date of a parsed date."""
    return day_number(d["year"], d["month"], d["day"]).cast("double") - 0.5 + (d["hour"] * 3600 + d["minute"] * 60 + d["second"]) / 86400.0


def julian_of(ts: Column) -> Column:
    """The Julian date of a timestamp (time zone UTC)."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(86400000000.0) + F.lit(2440587.5)


def mjd(jd: Column) -> Column:
    """The modified Julian date."""
    return jd - F.lit(MJD_ZERO)


def jd_of_mjd(m: Column) -> Column:
    """The Julian date of a modified one."""
    return m + F.lit(MJD_ZERO)


def date_of(jd: Column) -> Column:
    """A struct (year, month, day, hour, minute, second) of a Julian date, to milliseconds."""
    ms = F.round((jd + 0.5) * 86400000.0).cast("bigint")
    days, rest = _quotient(ms, 86400000), F.pmod(ms, F.lit(86400000))
    # Civil date from the day number: 400-year eras of 146097 days, counted from 1 March 0000.
    z = days - 1721120
    era = _quotient(z, 146097)
    doe = z - era * 146097
    yoe = _quotient(doe - _quotient(doe, 1460) + _quotient(doe, 36524) - _quotient(doe, 146096), 365)
    doy = doe - (365 * yoe + _quotient(yoe, 4) - _quotient(yoe, 100))
    mp = _quotient(5 * doy + 2, 153)
    month = F.when(mp < 10, mp + 3).otherwise(mp - 9)
    year = yoe + era * 400 + F.when(month <= 2, 1).otherwise(0)
    return F.struct(
        year.cast("int").alias("year"), month.cast("int").alias("month"), (doy - _quotient(153 * mp + 2, 5) + 1).cast("int").alias("day"),
        _quotient(rest, 3600000).cast("int").alias("hour"), F.pmod(_quotient(rest, 60000), F.lit(60)).cast("int").alias("minute"), (F.pmod(rest, F.lit(60000)) / 1000.0).alias("second"),
    )


def julian_epoch(jd: Column) -> Column:
    return F.lit(2000.0) + (jd - F.lit(2451545.0)) / F.lit(365.25)


def jd_of_julian_epoch(e: Column) -> Column:
    return F.lit(2451545.0) + (e - F.lit(2000.0)) * F.lit(365.25)


def besselian_epoch(jd: Column) -> Column:
    return F.lit(1900.0) + (jd - F.lit(2415020.31352)) / F.lit(365.242198781)


def jd_of_besselian_epoch(e: Column) -> Column:
    return F.lit(2415020.31352) + (e - F.lit(1900.0)) * F.lit(365.242198781)


#: Fixed values of the standard: time systems, other names of them, reference positions by three letters.
SYSTEMS = ("UTC", "TAI", "TT", "TDB", "TCG", "TCB", "UT1", "GPS", "LOCAL")
SYNONYMS = {"TDT": "TT", "ET": "TT", "IAT": "TAI", "GMT": "UTC", "UT": "UT1"}
POSITIONS = ("TOP", "GEO", "BAR", "REL", "CUS", "HEL", "GAL", "EMB", "MER", "VEN", "MAR", "JUP", "SAT", "URA", "NEP", "MOO")


def time_system(text: Column) -> Column:
    """The time system: a realization in brackets is left out, other names are replaced; else null."""
    name = F.upper(F.trim(F.regexp_replace(text, r"\(.*\)", "")))
    found = name
    for k, v in SYNONYMS.items():
        found = F.when(name == k, v).otherwise(found)
    return F.when(found.isin(*SYSTEMS), found)


def reference_position(text: Column) -> Column:
    """The three letters of a time reference position, or null."""
    short = F.upper(F.substring(F.trim(text), 1, 3))
    return F.when(short.isin(*POSITIONS), short)


def mjd_reference(jd=None, jdi=None, jdf=None, date=None, m=None, mi=None, mf=None) -> Column:
    """The reference time as MJD: JDREF before DATEREF before MJDREF; a pair of whole and fraction before one number."""
    none = F.lit(None).cast("double")
    jd, jdi, jdf, m, mi, mf = (none if x is None else x.cast("double") for x in (jd, jdi, jdf, m, mi, mf))
    day = none if date is None else mjd(julian_date(parse(date)))
    return F.coalesce(mjd(jdi + jdf), mjd(jd), mjd(F.coalesce(jdi, jdf)), day, mi + mf, m, mi, mf)
