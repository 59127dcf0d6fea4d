"""Column functions: identifiers, times, labels, decisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: guards denominators of the published formulas.
EPS = 1e-8


def let(value: Column, use) -> Column:
    """use(value) with value written, and computed, once: a name used twice in Python is an expression written twice."""
    return F.transform(F.array(value), use)[0]


def no_nan(col: Column) -> Column:
    """NaN as null: Spark's aggregates skip only null."""
    return F.nanvl(col.cast("double"), F.lit(None).cast("double"))


def tidy(col: Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero. The small shift takes exact halves off the edge, where engines differ."""
    return F.round(col + F.lit(1e-9), digits) + F.lit(0.0)


def normalize_subject_id(col: Column) -> Column:
    """Trimmed text; digits with a trailing .0 lose it; null is empty."""
    return F.coalesce(F.regexp_replace(F.trim(col.cast("string")), r"^(\d+)\.0$", "$1"), F.lit(""))


def epoch_seconds(col: Column) -> Column:
    """Seconds since 1970 of a time without zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), col.cast("timestamp_ntz")) / 1e6


def parse_clock(col: Column) -> Column:
    """Seconds of the day of H[:M[:S]]; parts may have decimals, which are cut; missing parts are 0; null if it can't be read."""

    def read(parts: Column) -> Column:
        part = lambda i: F.when(F.size(parts) > i, F.floor(F.try_element_at(parts, F.lit(i + 1)).try_cast("double"))).otherwise(F.lit(0))
        return let(F.when(F.size(parts) <= 3, F.array(part(0), part(1), part(2))), seconds)

    def seconds(p: Column) -> Column:
        return F.when(p[0].between(0, 23) & p[1].between(0, 59) & p[2].between(0, 59), (p[0] * 3600 + p[1] * 60 + p[2]).cast("int"))

    return let(F.split(F.trim(col.cast("string")), ":"), read)


def parse_date(col: Column) -> Column:
    """A date from year-month-day, month/day/year or day.month.year text; null if it can't be read."""
    forms = ((r"^\d{4}-\d{1,2}-\d{1,2}", "yyyy-M-d"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"), (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"))
    return let(F.trim(col.cast("string")), lambda text: F.coalesce(*[F.try_to_timestamp(F.regexp_extract(text, pattern, 0), F.lit(form)).cast("date") for pattern, form in forms]))


def iso_utc(seconds: Column) -> Column:
    """ISO-8601 text in UTC of epoch seconds, with microseconds, whatever the session's zone."""
    moment = F.timestamp_add("MICROSECOND", F.round(seconds * 1e6).cast("long"), F.expr("timestamp_ntz'1970-01-01 00:00:00'")).cast("string")
    return let(moment, lambda m: F.concat(F.replace(F.substring(m, 1, 19), F.lit(" "), F.lit("T")), F.lit("."), F.rpad(F.substring(m, 21, 6), 6, "0"), F.lit("+00:00")))


def group_id(source: Column, subject: Column) -> Column:
    return F.concat_ws(":", F.coalesce(source, F.lit("")), F.coalesce(subject, F.lit("")))


def threshold_label(positive: Column, threshold: Column | float) -> Column:
    """1 at or above the threshold, else 0; a null score stays null."""
    return F.when(positive.isNotNull(), (positive >= threshold).cast("int"))


def argmax_label(probabilities: Column) -> Column:
    """The place, from 0, of the first largest probability."""
    return (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("int")


def predicted_confidence(probabilities: Column, label: Column) -> Column:
    """The probability of the label that was decided on, which a threshold may have chosen."""
    return F.try_element_at(probabilities, label + 1)
