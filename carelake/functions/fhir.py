"""Column expressions over FHIR fields. All are built-in Catalyst expressions
(no Python per row), so they stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from carelake.functions import codes


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def ref_id(col: str | Column) -> Column:
    """`Type/id` -> `id`; a bare id passes through; null stays null."""
    return F.regexp_replace(_c(col), codes.REFERENCE_PREFIX_PATTERN, "")


def strip_prefix(col: str | Column, prefix: str) -> Column:
    """Type-specific strip, e.g. 'Patient/' (D2)."""
    return F.regexp_replace(_c(col), prefix, "")


def parse_instant(col: str | Column) -> Column:
    """Two-format timestamp: `MM/dd/yyyy HH:mm` or ISO 8601; junk -> null.

    No text parses under both formats, so their order does not change the
    result (D4). The cheap ISO cast goes first, and the pattern parse (whose
    failures are costly) runs only on text with a '/', which it requires."""
    c = _c(col)
    return F.coalesce(F.try_to_timestamp(c), F.when(c.contains("/"), F.try_to_timestamp(c, F.lit(codes.US_DATE_TIME_FORMAT))))


def parse_iso(col: str | Column) -> Column:
    """ISO 8601 only; other formats become null."""
    return F.try_to_timestamp(_c(col))


def to_ntz(col: str | Column) -> Column:
    """Session-zone timestamp -> timestamp_ntz (wall clock), for zone-free output."""
    return _c(col).cast("timestamp_ntz")


def safe_double(col: str | Column) -> Column:
    return _c(col).try_cast("double")


def is_inpatient(class_code: str | Column) -> Column:
    """upper(class) = 'IMP' -> 1 else 0."""
    return F.when(F.upper(_c(class_code)) == F.lit("IMP"), F.lit(1)).otherwise(F.lit(0))


def length_of_stay_days(start: str | Column, end: str | Column) -> Column:
    """greatest(datediff(end, start), 0) when both are present, else null."""
    s, e = _c(start), _c(end)
    return F.when(s.isNotNull() & e.isNotNull(), F.greatest(F.datediff(e, s), F.lit(0))).otherwise(
        F.lit(None).cast("int")
    )


def week_start(ts: str | Column) -> Column:
    """Monday-based week bucket as DATE."""
    return F.date_trunc("week", _c(ts)).cast("date")


def month_start(ts: str | Column) -> Column:
    """First day of month as DATE."""
    return F.trunc(_c(ts), "month")


def usd_amount(value: str | Column, currency: str | Column) -> Column:
    """Amount only when currency is USD."""
    return F.when(_c(currency) == F.lit("USD"), _c(value)).otherwise(F.lit(None).cast("double"))


def display_name(first: str | Column, last: str | Column) -> Column:
    """Blank parts -> null, join with a space, trim, collapse runs of spaces."""
    parts = [F.nullif(F.trim(_c(part)), F.lit("")) for part in (first, last)]
    return F.regexp_replace(F.concat_ws(" ", *parts), r"\s{2,}", " ")


def is_test_name(full_name: str | Column, wide: bool = False) -> Column:
    """Test-patient name rule (F1; `wide` = F2)."""
    pattern = codes.TEST_NAME_PATTERN_WIDE if wide else codes.TEST_NAME_PATTERN
    return F.lower(F.coalesce(_c(full_name), F.lit(""))).rlike(pattern)


def active_flag(active: str | Column) -> Column:
    """'true' -> True, 'false' -> False, anything else -> True."""
    a = F.lower(_c(active))
    return F.when(a == F.lit("true"), F.lit(True)).when(a == F.lit("false"), F.lit(False)).otherwise(F.lit(True))


def denied_or_rejected(status: str | Column) -> Column:
    return F.when(F.lower(_c(status)).isin(*codes.DENIED_OR_REJECTED), F.lit(1)).otherwise(F.lit(0))


def excluded_status(status: str | Column, excluded=None) -> Column:
    excluded = codes.EXCLUDED_CLAIM_STATUSES if excluded is None else list(excluded)
    return F.when(F.lower(_c(status)).isin(*excluded), F.lit(1)).otherwise(F.lit(0))


def guarded_ratio(num: str | Column, den: str | Column, digits: int = 6) -> Column:
    """num/den when den > 0 else 0.0, rounded for engine-independent output."""
    return F.round(
        F.when(_c(den) > F.lit(0), F.try_divide(_c(num).cast("double"), _c(den).cast("double"))).otherwise(
            F.lit(0.0)
        ),
        digits,
    )


def money_sum(col: str | Column) -> Column:
    """Order-independent money sum: sum as decimal(18,2) then back to double."""
    return F.sum(_c(col).try_cast("decimal(18,2)")).cast("double")
