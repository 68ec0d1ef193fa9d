"""Column expressions: parsing, calendar, labels and guarded arithmetic.

All of them are built-in expressions, so they stay inside generated code.  Timestamps are
TIMESTAMP_NTZ throughout, so no result depends on the session time zone.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# Tariff bands as (label, first hour, last hour), tested in this order.
TARIFF_BANDS = (("off_peak", 0, 5), ("critical", 9, 11), ("full", 6, 23))
DAY_LABELS = ("weekday", "weekend")


def as_column(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: ColumnOrName) -> Column:
    """NaN as NULL: Spark sorts NaN above every number, so it must not reach a comparison."""
    return F.nanvl(as_column(c), F.lit(None).cast("double"))


def ratio(numerator: ColumnOrName, denominator: ColumnOrName) -> Column:
    """Quotient that is NULL when the denominator is 0."""
    return as_column(numerator) / F.nullif(as_column(denominator), F.lit(0.0))


def decimal_comma(c: ColumnOrName) -> Column:
    """Number from text such as '101,53'; text that is no number gives NULL."""
    return nan_to_null(F.replace(as_column(c), F.lit(","), F.lit(".")).try_cast("double"))


def timestamp_from_text(c: ColumnOrName, fmt: str | None = None, strict: bool = True) -> Column:
    """Timestamp without time zone; bad text raises when `strict`, otherwise gives NULL."""
    text = as_column(c)
    parsed = text.try_cast("timestamp_ntz") if fmt is None else F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz")
    if not strict:
        return parsed
    complaint = F.raise_error(F.concat(F.lit("no timestamp: "), text.cast("string")))
    return F.when(text.isNotNull() & parsed.isNull(), complaint.cast("timestamp_ntz")).otherwise(parsed)


def at_hour(day: ColumnOrName, hour: ColumnOrName) -> Column:
    """TIMESTAMP_NTZ of a date and an hour (`date_trunc` would go through the session time zone)."""
    return as_column(day).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), as_column(hour))


def exact_sum(c: ColumnOrName, places: int | None = None) -> Column:
    """Sum of the numbers as they are written, so it does not depend on the order of the rows.

    Numbers are added as decimals with 18 places; where one is too large for that, or the sum is, the
    plain sum of doubles takes over.  NaN is missing.  `places` rounds the total, never a number before it.
    """
    x = nan_to_null(as_column(c).cast("double"))
    number = x.try_cast("decimal(38,18)")
    fits = F.count_if(x.isNotNull() & number.isNull()) == 0
    total = F.coalesce(F.when(fits, F.try_sum(number).cast("double")), F.sum(x))
    return total if places is None else F.round(total, places)


def iso_weekday(ts: ColumnOrName) -> Column:
    """1 = Monday ... 7 = Sunday, whatever the session settings."""
    return F.weekday(as_column(ts)) + 1


def week_start(ts: ColumnOrName) -> Column:
    """Monday of the ISO week."""
    day = F.to_date(as_column(ts))
    return F.date_sub(day, F.weekday(day))


def iso_year(ts: ColumnOrName) -> Column:
    """Year the ISO week belongs to."""
    return F.year(F.date_add(week_start(ts), 3))


def rolling_week_block(ts: ColumnOrName, start: date | str) -> Column:
    """First day of the 7-day block, counted from `start`, that holds the timestamp."""
    first = F.to_date(F.lit(str(start)))
    weeks = F.floor(F.datediff(F.to_date(as_column(ts)), first) / 7).cast("int")
    return F.date_add(first, weeks * 7)


def day_type_label(ts: ColumnOrName, labels: tuple[str, str] = DAY_LABELS) -> Column:
    """Monday to Friday against Saturday and Sunday."""
    return F.when(iso_weekday(ts) <= 5, F.lit(labels[0])).otherwise(F.lit(labels[1]))


def in_hours(hour: ColumnOrName, span: tuple[int, int]) -> Column:
    """Whether an hour lies in the span, both ends included; a span such as (22, 2) goes over midnight."""
    h, (first, last) = as_column(hour), span
    return h.between(first, last) if first <= last else (h >= first) | (h <= last)


def tariff_label(
    hour: ColumnOrName, bands: Sequence[tuple[str, int, int]] = TARIFF_BANDS, other: str = "out"
) -> Column:
    """Label of the first band whose hours (both ends included) hold `hour`."""
    (label, first, last), *rest = bands
    cases = reduce(
        lambda case, band: case.when(in_hours(hour, band[1:]), F.lit(band[0])),
        rest,
        F.when(in_hours(hour, (first, last)), F.lit(label)),
    )
    return cases.otherwise(F.lit(other))


def status_label(c: ColumnOrName, threshold: float, yes: str, no: str) -> Column:
    """`yes` above the threshold, otherwise (also for NULL) `no`."""
    return F.when(as_column(c) > threshold, F.lit(yes)).otherwise(F.lit(no))


def differs_by_percent(new: ColumnOrName, old: ColumnOrName, pct: float) -> Column:
    """Whether `new` lies more than `pct` percent of `old` away from it; never true for an `old` of 0 or NULL.

    Numbers of up to ten places are compared as they are written, in decimals, so a change of just `pct`
    percent is not taken for a larger one by the rounding of doubles.  Others are compared as doubles.
    """
    a, b, limit = as_column(new), as_column(old), Decimal(str(pct))
    plain = F.abs(100.0 * ratio(a - b, b)) > pct
    if not limit.is_finite() or len(limit.as_tuple().digits) > 10 or not -6 <= limit.as_tuple().exponent <= 0:
        return plain
    x, y = a.try_cast("decimal(26,10)"), b.try_cast("decimal(26,10)")
    written = (x.cast("double") == a) & (y.cast("double") == b)
    return F.when(written, (y != 0) & (F.abs(x - y) * F.lit(Decimal(100)) > F.abs(y) * F.lit(limit))).otherwise(plain)


def correlation(y: ColumnOrName, x: ColumnOrName) -> Column:
    """Pearson correlation over the rows where both are set; NULL if either does not vary."""
    a, b = as_column(y), as_column(x)
    spread = F.sqrt(F.regr_sxx(a, b) * F.regr_syy(a, b))
    return F.regr_sxy(a, b) / F.nullif(spread, F.lit(0.0))


def normal_density(x: ColumnOrName, mean: ColumnOrName, stddev: ColumnOrName) -> Column:
    """Density of the normal distribution; NULL for a zero deviation."""
    s = F.nullif(as_column(stddev), F.lit(0.0))
    z = (as_column(x) - as_column(mean)) / s
    return F.exp(-0.5 * z * z) / (s * F.sqrt(2 * F.pi()))
