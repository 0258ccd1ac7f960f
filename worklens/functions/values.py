"""Value rules of extracted parameters, plus sizes, percentages and back-off."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from worklens import vocab
from worklens.functions.text import col, strip

_QUOTED = r"""["']?\s*:\s*["']([^"']+)["']"""


def clean_value(c: Column | str) -> Column:
    """Drop a leading colon; take the quoted text after a colon, else trim quotes and commas."""
    raw = col(c).cast("string")
    text = F.regexp_replace(raw, r"^\s*:\s*", "")
    quoted = strip(F.regexp_extract(text, _QUOTED, 1))
    return F.when(raw == "", raw).when(text.rlike(_QUOTED), quoted).otherwise(F.btrim(text, F.lit(" \"',")))


def is_missing(c: Column | str) -> Column:
    text = F.lower(strip(col(c).cast("string")))
    return text.isNull() | text.isin("", "not found", "not available", "n/a")


def postcode_area(c: Column | str) -> Column:
    """Leading letters of a UK postcode, or the cleaned text when there are none."""
    text = strip(F.regexp_replace(col(c), r"(?i)^\s*of Project Location:?\*?\s*", ""))
    area = F.regexp_extract(F.upper(text), "([A-Z]{1,2})[0-9]", 1)
    return (
        F.when(text.rlike(r"(?i)not\s+provided|not\s+found|none"), F.lit("Not provided"))
        .when(area != "", area)
        .otherwise(text)
    )


def insulation_category(c: Column | str) -> Column:
    """Category of the first listed product contained in the value, or containing it."""

    def rule(bound: Column) -> Column:
        value, lowered = bound["v"], bound["l"]
        out = F.when(value.isNull() | value.isin("", "Not found"), value)
        for category, products in vocab.INSULATION_CATEGORIES:
            hit = F.lit(False)
            for product in dict.fromkeys(p.lower() for p in products):
                hit = hit | lowered.contains(product) | F.lit(product).contains(lowered)
            out = out.when(hit, F.lit(category))
        return out.otherwise(value)

    # The one-element transform binds the value once for the many comparisons.
    given = F.transform(F.array(col(c)), lambda v: F.struct(v.alias("v"), F.lower(v).alias("l")))
    return F.transform(given, rule)[0]


def percent_text(c: Column | str) -> Column:
    """One-decimal percentage, rounded half to even."""
    return F.concat(F.format_number(col(c) * 100, 1), F.lit("%"))


def byte_size_text(c: Column | str) -> Column:
    size = col(c).cast("double")
    unit = F.floor(F.log(size) / F.log(F.lit(1024.0))).cast("int")
    value = size / F.pow(F.lit(1024.0), unit)
    names = F.array(*[F.lit(u) for u in ("B", "KB", "MB", "GB", "TB")])
    shown = F.when(value >= 10, F.format_string("%.1f", value)).otherwise(F.format_string("%.2f", value))
    return (
        F.when(size.isNull(), F.lit("—"))
        .when(size == 0, F.lit("0 B"))
        .otherwise(F.concat(shown, F.lit(" "), F.try_element_at(names, unit + 1)))
    )


def retry_delay_seconds(attempts: Column | str) -> Column:
    """60 s doubled per earlier attempt, at most one hour."""
    exponent = F.least(F.greatest(col(attempts) - 1, F.lit(0)), F.lit(62))
    return F.least(F.lit(3600.0), F.pow(F.lit(2.0), exponent) * 60).cast("long")


def readiness_delay_seconds(
    checks: Column | str,
    initial: int = vocab.READINESS_INITIAL_SECONDS,
    maximum: int = vocab.READINESS_MAX_SECONDS,
) -> Column:
    exponent = F.least(col(checks), F.lit(62))
    return F.least(F.lit(float(maximum)), F.pow(F.lit(2.0), exponent) * initial).cast("long")


def lenient_size(c: Column | str) -> Column:
    """Reported byte size; unreadable or negative becomes NULL."""
    size = F.trim(col(c).cast("string")).try_cast("long")
    return F.when(size >= 0, size)


def project_number(c: Column | str) -> Column:
    """Digits after ``TP`` in a file name, NULL when absent."""
    return F.nullif(F.regexp_extract(col(c), r"(?i)\bTP[\s_-]*(\d{4,})", 1), F.lit(""))


LABELS = "struct<labels:array<struct<id:bigint,name:string>>>"


def label_id(value: Column | str, settings: Column | str) -> Column:
    """Id of the first settings label with exactly this name, NULL when unmapped."""
    labels = F.from_json(col(settings), LABELS)["labels"]
    hits = F.filter(labels, lambda x: x["name"] == col(value))
    return F.when(F.length(col(value)) > 0, F.try_element_at(hits, F.lit(1))["id"])
