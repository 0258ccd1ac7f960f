"""Date and time rules; the session time zone must be UTC."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from worklens.functions.text import col, strip
from worklens.functions.values import clean_value

_ISO = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.,][0-9]+)?)?"
    r"([Zz]|[+-][0-9]{2}:?[0-9]{2})$"
)


def parse_zoned(c: Column | str) -> Column:
    """Instant of an ISO text that carries a zone; anything else is NULL."""
    text = strip(c)
    zoned = F.regexp_replace(F.regexp_replace(text, "[Zz]$", "+00:00"), r"([+-][0-9]{2})([0-9]{2})$", "$1:$2")
    plain = F.replace(F.regexp_replace(zoned, r"([.,][0-9]{6})[0-9]+", "$1"), F.lit(","), F.lit("."))
    return F.when(text.rlike(_ISO), plain.try_cast("timestamp"))


def iso_utc(instant: Column | str) -> Column:
    """``2026-01-30T15:45:00Z``, with six fraction digits only when they are not zero."""
    t = col(instant)
    micros = F.pmod(F.unix_micros(t), F.lit(1_000_000))
    fraction = F.when(micros > 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))).otherwise("")
    return F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("Z"))


def normalize_utc(c: Column | str) -> Column:
    return iso_utc(parse_zoned(c))


def mail_date_in_london(c: Column | str) -> Column:
    """Mail date shown in Europe/London with its offset; unreadable text stays as it is."""
    raw = col(c)
    text = F.regexp_replace(F.trim(raw), r"^[A-Za-z]{3},?\s+", "")
    text = F.regexp_replace(text, r"\s*\([^)]*\)$", "")
    text = F.regexp_replace(text, r"\s+(GMT|UTC|UT|Z)$", " +0000")
    text = F.regexp_replace(text, r"\s+", " ")
    zoned = F.coalesce(
        F.try_to_timestamp(text, F.lit("d MMM yyyy HH:mm:ss xx")),
        F.try_to_timestamp(text, F.lit("d MMM yyyy HH:mm xx")),
        F.try_to_timestamp(text, F.lit("d MMM yyyy HH:mm:ss")),
        F.try_to_timestamp(text, F.lit("d MMM yyyy HH:mm")),
    )
    local = F.from_utc_timestamp(zoned, "Europe/London")
    minutes = ((F.unix_micros(local) - F.unix_micros(zoned)) / F.lit(60_000_000)).cast("int")
    offset = F.concat(
        F.when(minutes < 0, "-").otherwise("+"),
        F.lpad(F.floor(F.abs(minutes) / 60).cast("string"), 2, "0"),
        F.lpad(F.pmod(F.abs(minutes), F.lit(60)).cast("string"), 2, "0"),
    )
    shown = F.concat(F.date_format(local, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" "), offset)
    return F.coalesce(shown, raw)


# Accepted date layouts, tried in this order (pattern, mask).
DATE_LAYOUTS = (
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    (r"^\d{1,2} [A-Za-z]+ \d{4}$", "d MMMM yyyy"),
    (r"^[A-Za-z]+ \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
)
TWO_DIGIT_YEAR = r"^(\d{1,2})([/-])(\d{1,2})([/-])(\d{2})$"


def flexible_date(c: Column | str) -> Column:
    """ISO date of a value in one of the accepted layouts, else the empty string."""
    text = F.regexp_replace(strip(clean_value(c)), r"\s+", " ")
    year = F.regexp_extract(text, TWO_DIGIT_YEAR, 5)
    century = F.when(year >= "69", "19").otherwise("20")
    same_sign = F.regexp_extract(text, TWO_DIGIT_YEAR, 2) == F.regexp_extract(text, TWO_DIGIT_YEAR, 4)
    long_year = F.concat(
        century,
        year,
        F.lit("-"),
        F.regexp_extract(text, TWO_DIGIT_YEAR, 3),
        F.lit("-"),
        F.regexp_extract(text, TWO_DIGIT_YEAR, 1),
    )
    tries = [F.when(text.rlike(p), F.try_to_timestamp(text, F.lit(mask))) for p, mask in DATE_LAYOUTS]
    tries.append(F.when(text.rlike(TWO_DIGIT_YEAR) & same_sign, F.try_to_timestamp(long_year, F.lit("yyyy-M-d"))))
    return F.coalesce(F.date_format(F.coalesce(*tries), "yyyy-MM-dd"), F.lit(""))


_CLOCK = r"^(\d{1,2})[:.](\d{2})(?:\s*(AM|PM|am|pm))?$"


def hour_minute(c: Column | str) -> Column:
    """``struct<hour,minute>`` of ``H:MM`` or ``H.MM`` with an optional AM/PM, else NULL."""
    text = strip(clean_value(c))
    hour = F.regexp_extract(text, _CLOCK, 1).try_cast("int")
    half = F.upper(F.regexp_extract(text, _CLOCK, 3))
    shifted = (
        F.when((half == "PM") & (hour != 12), hour + 12).when((half == "AM") & (hour == 12), F.lit(0)).otherwise(hour)
    )
    minute = F.regexp_extract(text, _CLOCK, 2).try_cast("int")
    return F.when(text.rlike(_CLOCK), F.struct(shifted.alias("hour"), minute.alias("minute")))


_HEADER_DATE = r"(?isd)EMAIL CONTENT:\s*From:.*?\nTo:.*?\nSubject:.*?\nDate:\s*(.+?)\s*(?:\n|\z)"


def header_date(all_text: Column | str) -> Column:
    """``struct<date_received,hour_received>`` from the first mail header; parts may be NULL.

    Without a readable date the hour is ignored as well.
    """
    line = F.regexp_extract(col(all_text), _HEADER_DATE, 1)
    day = F.nullif(F.regexp_extract(line, r"\d{1,2} \w{3} \d{4}", 0), F.lit(""))
    hour = F.nullif(F.regexp_extract(line, r"\d{2}:\d{2}", 0), F.lit(""))
    return F.struct(day.alias("date_received"), F.when(day.isNotNull(), hour).alias("hour_received"))


def age_seconds(now: Column, since: Column | str) -> Column:
    """Seconds from ``since`` to ``now``, never negative, three decimals."""
    micros = F.unix_micros(now) - F.unix_micros(col(since).cast("timestamp"))
    return F.round(F.when(micros < 0, F.lit(0.0)).otherwise(micros / F.lit(1e6)), 3)


def instant(text: str) -> Column:
    """A literal point in time (UTC)."""
    return F.lit(text).cast("timestamp")


def plus_seconds(t: Column | str, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(col(t)) + (seconds * 1_000_000).cast("long"))
