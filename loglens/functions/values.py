"""Numeric, date and label expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_text(seconds: Column) -> Column:
    """``YYYY-MM-DD HH:MM`` in UTC; a value that is no number is returned unchanged."""
    as_number = seconds.try_cast("bigint")
    text = F.date_format(F.timestamp_seconds(as_number), "yyyy-MM-dd HH:mm")
    return F.coalesce(text, seconds.cast("string"))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(value, F.lit(high)))


def ratio(part: Column, whole: Column, empty: float = 0.0) -> Column:
    """``part / whole`` with a fixed answer for an empty denominator."""
    return F.when(whole == 0, F.lit(empty)).otherwise(part.cast("double") / F.nullif(whole, F.lit(0)))


def round_half(value: Column, digits: int) -> Column:
    """Rounded as SQL engines round a double: the nearest whole multiple, halves away from zero, of what the double holds.
    ``F.round`` goes by its decimal digits instead, so 57 / 800 (a little less than 0.07125) would become 0.0713."""
    return F.round(value * 10.0**digits) / 10.0**digits


def reduction_pct(groups: Column, total: Column) -> Column:
    """How much smaller ``groups`` is than ``total``, in percent with one digit."""
    kept = groups.cast("double") / F.nullif(total, F.lit(0))
    return F.when(total > 0, F.round((1 - kept) * 100, 1)).otherwise(F.lit(0.0))


def severity_band(score: Column, p95: Column, p85: Column, p70: Column) -> Column:
    return (
        F.when(score >= p95, "CRITICAL")
        .when(score >= p85, "HIGH")
        .when(score >= p70, "MEDIUM")
        .otherwise("LOW")
    )


def worst_severity(critical: Column, high: Column, medium: Column) -> Column:
    """Name of the most severe band that occurs in a group."""
    return (
        F.when(critical > 0, "CRITICAL").when(high > 0, "HIGH").when(medium > 0, "MEDIUM").otherwise("LOW")
    )


def severity_caption(critical: Column, high: Column, medium: Column, low: Column) -> Column:
    """Count and name of the band to headline: critical, else high, else the commonest."""
    return (
        F.when(critical > 0, F.format_string("%d CRITICAL", critical))
        .when(high > 0, F.format_string("%d HIGH", high))
        .when(low >= medium, F.format_string("%d LOW", low))
        .otherwise(F.format_string("%d MEDIUM", medium))
    )


def truth_text(flag: Column) -> Column:
    return F.when(flag == 1, "Anomaly").when(flag == 0, "Normal")


def percent_text(share: Column, digits: int) -> Column:
    return F.when(share.isNotNull(), F.format_string(f"%.{digits}f%%", share * 100))


def thousands_text(count: Column) -> Column:
    return F.format_number(count, 0)


def rounded(value: Column, digits: int) -> Column:
    """Half up, as figures are shown."""
    return F.round(value, digits)


def or_default(value: Column, default) -> Column:
    """A default for nulls; where it is a text, numbers become text as well."""
    return F.coalesce(value.cast("string") if isinstance(default, str) else value, F.lit(default))


def upper_parameter(value: str) -> Column:
    """A parameter that is compared without case."""
    return F.upper(F.lit(value))
