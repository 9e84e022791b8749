"""Times as column expressions: aware UTC stamps, local HHMM strings, wall-clock steps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UTC_STAMP = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|\+00:00)$"
#: Minutes that local time is ahead of UTC.
IST_MINUTES = 330


def aware_utc(text: Column) -> Column:
    """Seconds since 1970 of an ISO stamp in UTC; NULL for naive stamps, other offsets and nonsense."""
    plain = F.regexp_replace(F.regexp_replace(text, r"(Z|\+00:00)$", ""), "T", " ")
    return F.when(text.rlike(UTC_STAMP), F.unix_seconds(F.try_to_timestamp(F.concat(F.substring(plain, 1, 19), F.lit("+00:00")), F.lit("yyyy-MM-dd HH:mm:ssXXX"))))


def local_hhmm(hhmm: Column, day_start: Column, not_before: Column | None = None) -> Column:
    """Seconds since 1970 of a local HHMM on the local day that starts at ``day_start`` (seconds, UTC); rolls to the next day if it would be before ``not_before``."""
    ok = hhmm.rlike(r"^([01]\d|2[0-3])[0-5]\d$")
    at = day_start + F.substring(hhmm, 1, 2).cast("int") * 3600 + F.substring(hhmm, 3, 2).cast("int") * 60
    return F.when(ok, at if not_before is None else F.when(at < not_before, at + 86400).otherwise(at))


def ceil_to(seconds: Column, step: int) -> Column:
    return (F.ceil(seconds / step) * step).cast("long")


def granule_time(name: Column) -> Column:
    """Seconds since 1970 of the start stamp in a granule's file name (…yyyyMMdd-Shhmmss…)."""
    stamp = F.concat(F.regexp_extract(name, r"(\d{8})-S(\d{6})", 1), F.regexp_extract(name, r"(\d{8})-S(\d{6})", 2), F.lit("+00:00"))
    return F.unix_seconds(F.try_to_timestamp(stamp, F.lit("yyyyMMddHHmmssXXX")))
