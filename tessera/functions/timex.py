"""Strict time normalisation: instants are (s, n) with floored seconds; what is unresolved says why."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RFC3339 = r"^(\d{4})-(\d{2})-(\d{2})T(\d{2}):(\d{2}):(\d{2})(?:\.(\d{1,9}))?(Z|[+-]\d{2}:\d{2})\z"
UNITS = {"s": 1, "ms": 1_000, "us": 1_000_000, "ns": 1_000_000_000}


def _micros(ntz: Column) -> Column:
    """Microseconds of a timestamp without zone since 1970, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ntz)


def _ntz(micros: Column) -> Column:
    """The timestamp without zone of microseconds since 1970."""
    zero, day = F.lit(0), F.lit(86_400_000_000)
    rest = F.pmod(micros, day)
    days = ((micros - rest) / day).cast("int")
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(days, zero, zero, (rest.cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(18,6)"))


def _iso(ntz: Column) -> Column:
    """Date and time to seconds; years have four digits at least and no sign but a minus."""
    year = F.year(ntz)
    text = F.when(year.between(0, 9999), F.lpad(year.cast("string"), 4, "0")).otherwise(year.cast("string"))
    return F.concat(text, F.date_format(ntz, "-MM-dd'T'HH:mm:ss"))


def _in_zone(utc: Column, zone: str) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def instant(s: Column, n: Column) -> Column:
    return F.struct(s.cast("long").alias("s"), n.cast("int").alias("n"))


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 in the proleptic Gregorian calendar, by integers only."""
    shifted = F.when(m <= 2, y - 1).otherwise(y)
    era = F.floor(shifted / 400)
    of_era = shifted - era * 400
    of_year = F.floor((153 * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5) + d - 1
    return era * 146097 + of_era * 365 + F.floor(of_era / 4) - F.floor(of_era / 100) + of_year - 719468


def parse_rfc3339(text: Column) -> Column:
    """struct(outcome, reason, s, n) of a strict RFC 3339 text."""
    part = lambda i: F.regexp_extract(text, RFC3339, i)
    number = lambda i: part(i).try_cast("long")
    y, mo, d, h, mi, sec = (number(i) for i in range(1, 7))
    zone = part(8)
    hours, minutes = F.substring(zone, 2, 2).try_cast("long"), F.substring(zone, 5, 2).try_cast("long")
    offset = F.when(zone == "Z", F.lit(0)).otherwise(F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1) * (hours * 3600 + minutes * 60))
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    last = F.when(mo.isin(4, 6, 9, 11), 30).when((mo == 2) & leap, 29).when(mo == 2, 28).otherwise(31)
    valid = text.rlike(RFC3339) & y.between(1, 9999) & mo.between(1, 12) & (d >= 1) & (d <= last) & (h <= 23) & (mi <= 59) & (sec <= 60) & ((zone == "Z") | ((hours <= 23) & (minutes <= 59)))
    valid = F.coalesce(valid, F.lit(False))
    seconds = days_from_civil(y, mo, d) * 86400 + h * 3600 + mi * 60 + sec - offset
    nanos = F.rpad(part(7), 9, "0").try_cast("int")
    outcome = F.when(text.isNull(), "missing").when(~valid, "invalid").when(sec == 60, "unsupported").when(zone == "-00:00", "ambiguous").otherwise("resolved")
    reason = F.when(valid & (sec == 60), "leap_second").when(valid & (zone == "-00:00"), "unknown_offset").otherwise(F.when(text.isNotNull() & ~valid, "malformed"))
    good = outcome == "resolved"
    return F.struct(outcome.alias("outcome"), reason.alias("reason"), F.when(good, seconds.cast("long")).alias("s"), F.when(good, F.coalesce(nanos, F.lit(0))).alias("n"))


def epoch(value: Column, unit: str) -> Column:
    """struct(s, n) of a count since 1970, with floored seconds."""
    per = UNITS[unit]
    return instant(F.floor(value / per) if per == 1 else (value - F.pmod(value, F.lit(per))) / per, F.pmod(value, F.lit(per)) * (1_000_000_000 // per))


def resolve_local(local: Column, zone: str, choose: str | None = None) -> Column:
    """struct(outcome, reason, utc) of a local timestamp without zone.

    Offsets that hold a day before and after are candidates; those that lead back to the same local time
    are kept. None is a gap, one is the answer, two are a fold that ``choose`` (earlier, later) must settle.
    """
    stamp = _micros(local.cast("timestamp_ntz"))
    offset = lambda at: _micros(_in_zone(_ntz(at), zone)) - at
    tries = F.array_distinct(F.array(*[stamp - offset(stamp + F.lit(d * 86_400_000_000)) for d in (-1, 1)]))
    held = F.array_sort(F.filter(tries, lambda u: _micros(_in_zone(_ntz(u), zone)) == stamp))
    n = F.size(held)
    outcome = F.when(n == 0, "invalid").when((n == 2) & F.lit(choose is None), "ambiguous").when((n == 1) & F.lit(choose is not None), "invalid").otherwise("resolved")
    reason = F.when(n == 0, "nonexistent_local_time").when((n == 2) & F.lit(choose is None), "fold").when((n == 1) & F.lit(choose is not None), "needless_fold")
    pick = F.try_element_at(held, F.when((n == 2) & F.lit(choose == "later"), 2).otherwise(1))
    return F.struct(outcome.alias("outcome"), reason.alias("reason"), F.when(outcome == "resolved", pick).alias("utc_micros"))


def date_only(text: Column, policy: str | None = None) -> Column:
    """A date is ambiguous unless a policy (start of day) says which instant it means."""
    day = F.try_to_date(text, "yyyy-MM-dd")
    good = text.rlike(r"^\d{4}-\d{2}-\d{2}\z") & day.isNotNull()
    outcome = F.when(text.isNull(), "missing").when(~good, "invalid").when(F.lit(policy is None), "ambiguous").otherwise("resolved")
    return F.struct(outcome.alias("outcome"), F.when(outcome == "ambiguous", "date_only_without_policy").alias("reason"), F.when(outcome == "resolved", F.unix_date(day).cast("long") * 86400).alias("s"))


def format_utc(s: Column, n: Column) -> Column:
    """RFC 3339 in UTC without trailing zeros of the fraction."""
    whole = _iso(_ntz(s * 1_000_000))
    fraction = F.rtrim(F.lpad(n.cast("string"), 9, "0"), F.lit("0"))
    return F.concat(whole, F.when(n == 0, "").otherwise(F.concat(F.lit("."), fraction)), F.lit("Z"))


def present_in_zone(s: Column, zone: str) -> Column:
    """Local text, its offset and the zone's name."""
    local = _in_zone(_ntz(s * 1_000_000), zone)
    minutes = ((_micros(local) - s * 1_000_000) / 60_000_000).cast("int")
    sign = F.when(minutes < 0, "-").otherwise("+")
    offset = F.concat(sign, F.lpad(F.floor(F.abs(minutes) / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.abs(minutes) % 60).cast("string"), 2, "0"))
    return F.concat(_iso(local), offset, F.lit(f"[{zone}]"))


def tick_to_utc(tick: Column, numerator: int, denominator: int, origin: int = 0) -> Column:
    """Nanoseconds of a tick at numerator/denominator ns per tick, ties to even, by integers only."""
    whole = tick.cast("decimal(38,0)") * numerator
    rest = F.pmod(whole, F.lit(denominator).cast("decimal(38,0)"))
    low = ((whole - rest) / denominator).cast("decimal(38,0)")
    up = (rest * 2 > denominator) | ((rest * 2 == denominator) & (F.pmod(low, F.lit(2).cast("decimal(38,0)")) == 1))
    return (low + F.when(up, 1).otherwise(0) + origin).cast("long")
