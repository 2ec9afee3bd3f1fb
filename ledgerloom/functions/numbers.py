"""Numbers in recognised text, and comparisons within a tolerance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.text import once

#: Rates that a doubtful percentage snaps to, and how near it must be.
RATES, RATE_TOLERANCE = (0, 10, 20, 25), 0.75


def close(actual: Column, expected: Column, absolute: float = 0.05, relative: float = 0.015) -> Column:
    """Whether two amounts agree within the larger of an absolute and a relative tolerance; null stays null."""
    return F.abs(actual - expected) <= F.greatest(F.lit(absolute), F.abs(expected) * relative)


def soft_number(text: Column) -> Column:
    """A double from text with capital O for 0 and blanks inside; of several commas, or several points, the last one is the
    decimal mark. Null where it isn't one number, as in 1,234.50, which could be read in two ways."""
    # most texts are one number as they stand; what is done to the others is bound, so that nothing is computed twice
    alone = lambda x, mark, other: ~x.contains(other) & (F.length(x) - F.length(F.translate(x, mark, "")) > 1)
    last = lambda x, mark: F.regexp_replace(x, rf"[{mark}](?=.*[{mark}])", "")
    mended = once(F.regexp_replace(F.translate(F.regexp_replace(text, "<[^>]*>", ""), "OО", "00"), "[^0-9,.-]", ""), lambda x: F.when(alone(x, ",", "."), last(x, ",")).when(alone(x, ".", ","), last(x, ".")).otherwise(x))
    return F.translate(F.when(text.rlike(r"^-?[0-9]+(?:[.,][0-9]+)?$"), text).otherwise(mended), ",", ".").try_cast("double")


def first_number(text: Column) -> Column:
    """The first decimal number of a text, else its first whole number."""
    decimal = F.nullif(F.regexp_extract(text, "([0-9]+[.,][0-9]+)", 1), F.lit(""))
    whole = F.nullif(F.regexp_extract(text, "([0-9]{1,15})", 1), F.lit(""))
    return F.coalesce(F.translate(decimal, ",", ".").try_cast("double"), whole.try_cast("double"))


def snap_rate(rate: Column) -> Column:
    """The nearest known rate within the tolerance, else the rate itself."""
    out = rate.cast("double")
    for known in reversed(RATES):
        out = F.when(F.abs(rate - known) <= RATE_TOLERANCE, F.lit(float(known))).otherwise(out)
    return out


def snap_quantity(quantity: Column) -> Column:
    """A whole number if one is within 0.03, else the quantity."""
    whole = F.floor(quantity + 0.5).cast("double")
    return F.when(F.abs(quantity - whole) <= 0.03, whole).otherwise(quantity)


def decimal_shift(value: Column, target: Column) -> Column:
    """Whether a value is its target with the point moved by one to three places."""
    out = F.lit(False)
    for scale in (10.0, 100.0, 1000.0):
        out = out | close(value * scale, target) | close(value / scale, target)
    return out & ~close(value, target)


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when((b != 0) & b.isNotNull(), a / b)
