"""Zone-independent timestamp helpers (all JVM-side column expressions).

Source tables carry ``timestamp_ntz``.  Watermarks need ``timestamp`` and
casting between the two uses the session zone, which the caller owns; these
helpers pin the conversion to UTC so results never depend on that zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH_NTZ = "1970-01-01 00:00:00"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ntz_to_instant(c) -> Column:
    """timestamp_ntz -> timestamp, reading the wall clock as UTC."""
    return F.concat(_col(c).cast("string"), F.lit("Z")).cast("timestamp")


def ntz_micros(c) -> Column:
    """Microseconds since the epoch of a wall-clock value read as UTC."""
    return F.unix_micros(ntz_to_instant(c))


def instant_to_ntz(c) -> Column:
    """timestamp -> timestamp_ntz holding its UTC wall clock."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(_col(c)),
                           F.lit(_EPOCH_NTZ).cast("timestamp_ntz"))


def seconds_between(start, end) -> Column:
    """(end - start) in seconds as a double, exact to the microsecond."""
    return (ntz_micros(end) - ntz_micros(start)) / F.lit(1_000_000.0)


def iso_text(c) -> Column:
    """ISO-8601 text the way the reference's result rows carry it.

    Seconds always; a six-digit fraction only when it is not zero
    (``2024-01-01T00:00:00`` / ``2024-01-01T00:00:00.000123``).
    """
    c = _col(c)
    frac = F.date_format(c, "SSSSSS")
    base = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(c.isNull(), F.lit(None).cast("string")).otherwise(
        F.concat(base, F.when(frac == F.lit("000000"), F.lit("")).otherwise(F.concat(F.lit("."), frac)))
    )


def ntz_literal(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def interval(text: str) -> Column:
    """Day-time interval literal, e.g. ``interval("30 minutes")``."""
    return F.expr(f"INTERVAL {text}")


def tumbling_start(ts, width: str) -> Column:
    """Start of the tumbling window of ``width`` holding ``ts`` (``timestamp_ntz``).

    Widths of whole minutes dividing an hour, whole hours dividing a day, and
    one day are computed from the wall-clock fields: zone-free and much
    cheaper than building ``window()`` structs.  Other widths use
    ``window()``.
    """
    c = _col(ts)
    n_text, unit = width.split()
    n, unit = int(n_text), unit.rstrip("s")
    zero = F.lit(0)
    if unit == "minute" and 60 % n == 0:
        return F.make_timestamp_ntz(F.year(c), F.month(c), F.dayofmonth(c), F.hour(c),
                                    F.floor(F.minute(c) / n) * n, zero)
    if unit == "hour" and 24 % n == 0:
        return F.make_timestamp_ntz(F.year(c), F.month(c), F.dayofmonth(c),
                                    F.floor(F.hour(c) / n) * n, zero, zero)
    if unit == "day" and n == 1:
        return F.make_timestamp_ntz(F.year(c), F.month(c), F.dayofmonth(c), zero, zero, zero)
    return F.window(c, width)["start"]
