"""Dates, times and durations as columns, without Python functions at run time.

LocalTime is a struct of the nanoseconds since midnight; LocalDateTime a timestamp without zone, to the
microsecond; ZonedDateTime a struct of the UTC timestamp and the offset in seconds; Duration a
struct of months, days, seconds and nanoseconds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_NS = 86_400_000_000_000
_TIME = r"^(\d{1,2}):(\d{2}):(\d{2})(?:\.(\d{1,9}))?$"
_ZONE = r"\s*([+-])(\d{2}):?(\d{2})$"
_DURATION = r"^([+-]?)P(?:(-?\d+)Y)?(?:(-?\d+)M)?(?:(-?\d+)W)?(?:(-?\d+)D)?(?:T(?:(-?\d+)H)?(?:(-?\d+)M)?(?:(-?\d+)(?:\.(\d{1,9}))?S)?)?$"


def _checked(text: Column, pattern: str, what: str, value: Column) -> Column:
    message = F.concat(F.lit(f"Eval error: invalid argument in {what}, actual "), text)
    wrong = F.raise_error(message)
    return F.when(text.isNull(), F.lit(None)).when(F.rlike(text, F.lit(pattern)), value).otherwise(wrong)


def _long(text: Column, pattern: str, group: int) -> Column:
    found = F.regexp_extract(text, pattern, group)
    return F.when(found == "", 0).otherwise(F.try_to_number(found, F.lit("S999999999999999")).cast("bigint")).cast("bigint")


def parse_date(text: Column) -> Column:
    return F.to_date(text, "yyyy-MM-dd")


def parse_local_time(text: Column) -> Column:
    part = lambda k: F.regexp_extract(text, _TIME, k).cast("bigint")
    fraction = F.rpad(F.regexp_extract(text, _TIME, 4), 9, "0").cast("bigint")
    ns = ((part(1) * 60 + part(2)) * 60 + part(3)) * 1_000_000_000 + fraction
    return _checked(text, _TIME, "localtime", F.struct(ns.cast("bigint").alias("ns")))


def parse_local_date_time(text: Column) -> Column:
    return F.replace(text, F.lit("T"), F.lit(" ")).cast("timestamp_ntz")


def parse_date_time(text: Column) -> Column:
    seconds = F.regexp_extract(text, _ZONE, 2).cast("int") * 3600 + F.regexp_extract(text, _ZONE, 3).cast("int") * 60
    offset = F.when(F.regexp_extract(text, _ZONE, 1) == "-", -seconds).otherwise(seconds)
    local = parse_local_date_time(F.regexp_replace(text, _ZONE, ""))
    utc = local - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), offset.cast("decimal(18,6)"))
    return _checked(text, _ZONE, "datetime", F.struct(utc.alias("utc"), offset.alias("offset_s")))


def parse_duration(text: Column) -> Column:
    part = lambda k: F.coalesce(F.nullif(F.regexp_extract(text, _DURATION, k), F.lit("")).cast("bigint"), F.lit(0).cast("bigint"))
    sign = F.when(F.regexp_extract(text, _DURATION, 1) == "-", -1).otherwise(1)
    fraction = F.coalesce(F.nullif(F.rpad(F.regexp_extract(text, _DURATION, 9), 9, "0"), F.lit("000000000")).cast("bigint"), F.lit(0).cast("bigint"))
    whole = F.regexp_extract(text, _DURATION, 8)
    nanos = F.when(whole.startswith("-"), -fraction).otherwise(fraction)
    months, days = part(2) * 12 + part(3), part(4) * 7 + part(5)
    seconds = part(6) * 3600 + part(7) * 60 + part(8)
    return _checked(text, _DURATION, "duration", duration(months * sign, days * sign, seconds * sign, nanos * sign))


def duration(months: Column, days: Column, seconds: Column, nanos: Column) -> Column:
    """A duration whose nanoseconds are 0 to 999999999; only they carry over."""
    carried = F.floor(nanos / 1_000_000_000)
    parts = {"months": months, "days": days, "seconds": seconds + carried, "nanos": nanos - carried * 1_000_000_000}
    return F.struct(*[v.cast("bigint").alias(k) for k, v in parts.items()])


def scaled(value: Column, factor: Column, whole: bool) -> Column:
    """A duration times a number; a fraction of a month or a day is rounded half away from zero."""
    if whole:
        return duration(*[value[k] * factor for k in ("months", "days", "seconds", "nanos")])
    total = (value["seconds"] + value["nanos"] / 1e9) * factor
    seconds = F.floor(total)
    return duration(F.round(value["months"] * factor), F.round(value["days"] * factor), seconds, F.round((total - seconds) * 1e9))


def combined(a: Column, b: Column, sign: int) -> Column:
    return duration(*[a[k] + sign * b[k] for k in ("months", "days", "seconds", "nanos")])


def date_plus(day: Column, span: Column, sign: int) -> Column:
    """Months first (to the month's end at most), then days; the time part has no effect."""
    return F.date_add(F.add_months(day, (span["months"] * sign).cast("int")), (span["days"] * sign).cast("int"))


def local_time_plus(time: Column, span: Column, sign: int) -> Column:
    """Only seconds and nanoseconds count; the clock wraps at midnight."""
    step = (span["seconds"] % 86_400) * 1_000_000_000 + span["nanos"]
    return F.struct(F.pmod(time["ns"] + sign * step, F.lit(DAY_NS)).cast("bigint").alias("ns"))


def local_date_time_plus(at: Column, span: Column, sign: int) -> Column:
    months = at + F.make_ym_interval(F.lit(0), (span["months"] * sign).cast("int"))
    seconds = (span["seconds"].cast("decimal(18,6)") + span["nanos"] / 1_000_000_000) * sign
    step = F.make_dt_interval((span["days"] * sign).cast("int"), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))
    return (months + step).cast("timestamp_ntz")


def date_time_plus(at: Column, span: Column, sign: int) -> Column:
    """Counted on the local clock; the offset stays."""
    shift = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), at["offset_s"].cast("decimal(18,6)"))
    moved = local_date_time_plus(at["utc"] + shift, span, sign) - shift
    return F.struct(moved.alias("utc"), at["offset_s"].alias("offset_s"))


def days_between(a: Column, b: Column) -> Column:
    zero = F.lit(0)
    return duration(zero, F.date_diff(a, b), zero, zero)


def print_local_time(time: Column) -> Column:
    nanos, seconds = time["ns"] % 1_000_000_000, F.floor(time["ns"] / 1_000_000_000)
    clock = F.format_string("%02d:%02d:%02d", F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60)
    fraction = F.regexp_replace(F.lpad(nanos.cast("string"), 9, "0"), r"(000|000000)$", "")
    return F.when(nanos == 0, clock).otherwise(F.concat(clock, F.lit("."), fraction))


def print_local_date_time(at: Column) -> Column:
    return at.cast("string")


def print_date_time(at: Column) -> Column:
    shift = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), at["offset_s"].cast("decimal(18,6)"))
    size = F.abs(at["offset_s"])
    zone = F.format_string("%s%02d:%02d", F.when(at["offset_s"] < 0, "-").otherwise("+"), F.floor(size / 3600), F.floor(size / 60) % 60)
    return F.concat((at["utc"] + shift).cast("string"), F.lit(" "), zone)


def print_duration(span: Column) -> Column:
    return F.format_string("P%dM%dDT%dS%d", span["months"], span["days"], span["seconds"], span["nanos"])
