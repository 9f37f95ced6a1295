"""Functions with PostgreSQL's meaning where Spark's differs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_div(a: Column, b: Column) -> Column:
    """Integer division that truncates toward zero; division by zero raises."""
    return F.when(b == 0, F.raise_error(F.lit("division by zero")).cast("long")).otherwise(F.call_function("div", a.cast("long"), b.cast("long")))


def sqrt(x: Column) -> Column:
    """Raises for negative numbers."""
    return F.when(x < 0, F.raise_error(F.lit("cannot take square root of a negative number")).cast("double")).otherwise(F.sqrt(x))


def ln(x: Column) -> Column:
    """Raises for zero and below."""
    return F.when(x <= 0, F.raise_error(F.lit("cannot take logarithm of zero or of a negative number")).cast("double")).otherwise(F.ln(x))


def log(x: Column) -> Column:
    """To base 10."""
    return F.when(x <= 0, F.raise_error(F.lit("cannot take logarithm of zero or of a negative number")).cast("double")).otherwise(F.log10(x))


def power(x: Column, y: Column) -> Column:
    """Raises where finite operands have no finite real result."""
    out = F.pow(x, y)
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return F.when(finite(x) & finite(y) & ~finite(out), F.raise_error(F.lit("value out of range")).cast("double")).otherwise(out)


def rounded(x: Column) -> Column:
    """Half away from zero, as a double."""
    return F.when(x < 0, -F.floor(-x + 0.5)).otherwise(F.floor(x + 0.5)).cast("double")


def dow(ts: Column) -> Column:
    """Sunday is 0."""
    return (F.dayofweek(ts) - 1).cast("long")


def isodow(ts: Column) -> Column:
    """Monday is 1, Sunday 7."""
    return (F.pmod(F.dayofweek(ts) + 5, F.lit(7)) + 1).cast("long")


def epoch(ts: Column) -> Column:
    """Seconds since 1970 with their fraction."""
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def age(later: Column, earlier: Column) -> Column:
    """Whole months and what is left in days and seconds: a struct (months, days, seconds), negative if later is earlier."""
    a, b = F.greatest(later, earlier).cast("timestamp"), F.least(later, earlier).cast("timestamp")
    months = F.floor(F.months_between(a, b, roundOff=False)).cast("int")
    # months_between takes two last days of a month for whole months; step back where adding them passes the end.
    months = F.when(_plus_months(b, months) > a, months - 1).otherwise(months)
    left = F.unix_micros(a) - F.unix_micros(_plus_months(b, months))
    sign = F.when(later < earlier, -1).otherwise(1)
    return F.struct((months * sign).cast("int").alias("months"), (F.floor(left / 86_400_000_000) * sign).cast("int").alias("days"), (left % 86_400_000_000 / 1e6 * sign).alias("seconds"))


def _plus_months(ts: Column, months: Column) -> Column:
    return F.timestamp_add("MONTH", months, ts)


def json_typeof(text: Column) -> Column:
    """object, array, string, number, boolean or null; NULL for NULL. The text must be valid JSON."""
    t = F.trim(text)
    first = F.substring(t, 1, 1)
    return F.when(first == "{", "object").when(first == "[", "array").when(first == '"', "string").when(t == "null", "null").when(t.isin("true", "false"), "boolean").when(t.isNotNull(), "number")


NUMBERS = "^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$"


def json_contains(text: Column, other) -> Column:  # noqa: ANN001
    """Containment (@>) of a constant, given as Python's dicts, lists and scalars: each of its keys and elements is in the document at the same place.

    The order and number of an array's elements don't matter; at the top a scalar is contained in an array that has it. NULL
    for NULL; text that is no JSON raises.
    """
    document = F.parse_json(text)

    def kind(v: Column) -> Column:
        return F.schema_of_variant(v)

    def holds(want):  # noqa: ANN001, ANN202
        return lambda e: within(e, want)

    def within(v: Column, want) -> Column:  # noqa: ANN001
        if isinstance(want, dict):
            out = kind(v).startswith("OBJECT")
            for k, x in want.items():
                quote = '"' if "'" in k else "'"
                if quote in k:
                    raise ValueError(f"a key with both kinds of quotes: {k}")
                inner = F.try_variant_get(v, f"$[{quote}{k}{quote}]", "variant")
                out = out & inner.isNotNull() & within(inner, x)
            return out
        if isinstance(want, list):
            out = kind(v).startswith("ARRAY")
            for x in want:
                out = out & F.exists(F.try_variant_get(v, "$", "array<variant>"), holds(x))
            return out
        if want is None:
            return F.is_variant_null(v)
        if isinstance(want, bool):
            return (kind(v) == "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == F.lit(want))
        if isinstance(want, (int, float)):
            return kind(v).rlike(NUMBERS) & (F.try_variant_get(v, "$", "double") == F.lit(float(want)))
        return (kind(v) == "STRING") & (F.try_variant_get(v, "$", "string") == F.lit(want))

    found = within(document, other)
    if not isinstance(other, (dict, list)):
        found = found | kind(document).startswith("ARRAY") & F.coalesce(F.exists(F.try_variant_get(document, "$", "array<variant>"), holds(other)), F.lit(False))
    return F.when(text.isNotNull(), F.coalesce(found, F.lit(False)))


def interval_seconds(i: Column) -> Column:
    """A day-time interval in seconds."""
    part = lambda unit: F.extract(F.lit(unit), i).cast("double")
    return part("DAY") * 86_400 + part("HOUR") * 3_600 + part("MINUTE") * 60 + part("SECOND")
