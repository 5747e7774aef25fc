"""Arithmetic, date, array, map, JSON and XML functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MILES_PER_RADIAN = 3958.7558657440547  # fixed value: 60 * 1.1515 * 180 / pi
KM_PER_MILE = 1.609344


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def great_circle_miles(lat1, lon1, lat2, lon2) -> Column:
    a, b = F.radians(_col(lat1)), F.radians(_col(lat2))
    d = F.radians(_col(lon1) - _col(lon2))
    cosine = F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(d)
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine))) * MILES_PER_RADIAN


def percent(part, whole) -> Column:
    return F.try_divide(_col(part) * F.lit(100.0), _col(whole))


def power_of_two(c) -> Column:
    """True for powers of two and for zero, as the bit trick has it."""
    c = _col(c).cast("bigint")
    return c.bitwiseAND(c - 1) == 0


def solexa_to_phred(c) -> Column:
    return F.round(10 * F.log10(F.pow(F.lit(10.0), _col(c) / 10.0) + 1)).cast("int")


def inches(cm) -> Column:
    return _col(cm) / 2.54


def centimeters(inch) -> Column:
    return _col(inch) * 2.54


def http_date(ts) -> Column:
    return F.concat(F.date_format(_col(ts), "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))


def parse_any(c, formats: list[str]) -> Column:
    """The first of several formats that reads the text; none gives NULL."""
    return F.coalesce(*[F.try_to_timestamp(_col(c), F.lit(f)) for f in formats])


def map_default(m, key: str, default) -> Column:
    return F.coalesce(F.try_element_at(_col(m), F.lit(key)), F.lit(default))


def int_ratio(a, b) -> Column:
    """Integer division; by zero gives NULL."""
    return F.when(_col(b) != 0, (_col(a) / _col(b)).cast("bigint"))


def rate(value, spent, over) -> Column:
    return F.try_divide(_col(value).cast("double") * F.lit(float(over)), _col(spent).cast("double"))


def attenuated(damage, distance, multiplier) -> Column:
    """Value falling with distance, never below zero."""
    return F.greatest(F.lit(0.0), (_col(damage) - _col(distance)) * F.lit(float(multiplier)))


def duration_text(seconds) -> Column:
    s = _col(seconds).cast("bigint")
    return F.format_string("%02d:%02d:%02d", (s / 3600).cast("bigint"), ((s % 3600) / 60).cast("bigint"), s % 60)


def signal_exp(arr) -> Column:
    return F.transform(_col(arr), lambda x: F.exp(x.cast("double")))


def scale_vector(arr, factors: list[float]) -> Column:
    return F.zip_with(_col(arr), F.array(*[F.lit(float(f)) for f in factors]), lambda x, f: x.cast("double") * f)


def delta_delta(arr) -> Column:
    """Second differences of an array, values before its start being zero: ``x[i] - 2 x[i-1] + x[i-2]``."""
    a = _col(arr)
    at = lambda i: F.when(i < 1, 0).otherwise(F.try_element_at(a, F.greatest(i, F.lit(1))))
    return F.when(F.size(a) == 0, a).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1))), lambda i: at(i) - 2 * at(i - 1) + at(i - 2))
    )


def bencode(m) -> Column:
    """A map of strings in bencoding: keys in order, lengths in UTF-8 bytes."""
    part = lambda x: F.concat(F.octet_length(x).cast("string"), F.lit(":"), x)
    entries = F.array_sort(F.map_entries(_col(m)))
    body = F.array_join(F.transform(entries, lambda e: F.concat(part(e["key"]), part(e["value"]))), "")
    return F.concat(F.lit("d"), body, F.lit("e"))


def t_score(r, n) -> Column:
    """Student's t of a correlation of ``n`` pairs; NULL for a perfect one or fewer than three pairs."""
    r, n = _col(r), _col(n)
    return F.when((n > 2) & (F.abs(r) < 1), r * F.sqrt(n - 2) / F.sqrt(1 - r * r))


def project(arr, matrix: list[list[float]]) -> Column:
    """A vector times a fixed matrix given by rows."""
    a = _col(arr)
    return F.array(*[F.aggregate(F.zip_with(a, F.array(*[F.lit(float(v)) for v in row]), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x) for row in matrix])
