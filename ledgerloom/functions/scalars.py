"""Scalar rules: numbers, rates, dates, codes and states as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.text import once

# fixed values: months as dates in words name them, and words for yes and no
MONTHS = ("января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря")
YES, NO = ("true", "1", "да", "yes"), ("false", "0", "нет", "no")
# fixed values: keys by which a payload shows its type
TYPE_KEYS = (("waybill", ("sender", "receiver", "items", "totals")), ("invoice", ("supplier", "customer", "items")), ("payment_order", ("payer", "recipient")))


def squeezed(text: Column) -> Column:
    """Runs of white space, no-break spaces included, as one blank; trimmed."""
    return F.trim(F.regexp_replace(text, r"[\s ]+", " "))


def two_places(x: Column) -> Column:
    return F.floor(x * 100 + 0.5) / 100


def flag(text: Column) -> Column:
    """true, false, or null for a text that says neither."""
    low = F.lower(F.trim(text))
    return F.when(low.isin(*YES), True).when(low.isin(*NO), False)


def number(text: Column) -> Column:
    """A number to two places from text with O, I and L for digits; null where none can be read."""
    digits = F.regexp_replace(F.translate(squeezed(text), "OОIІL,", "00111."), r"[^0-9.\-]", "")
    return two_places(digits.try_cast("double"))


def rate(x: Column) -> Column:
    """A share; above 1 it counts as percent, so 1 itself stays 1."""
    return F.when(x > 1, x / 100).otherwise(x)


def whole_or_cents(x: Column) -> Column:
    """A whole number if one is within a millionth, else two places."""
    return F.when(F.abs(x - F.floor(x + 0.5)) < 1e-6, F.floor(x + 0.5).cast("double")).otherwise(two_places(x))


def quantity(x: Column) -> Column:
    """A whole number if one is within 0.03, else three places; null if not above zero."""
    places = F.floor(x * 1000 + 0.5) / 1000
    return F.when(x > 0, F.when(F.abs(x - F.floor(x + 0.5)) <= 0.03, F.floor(x + 0.5).cast("double")).when(places > 0, places))


def first_number(text: Column) -> Column:
    """The first number of a text: a decimal one, else '12 34' as 12.34, else a whole one."""
    spaced = r"([0-9]+)\s+([0-9]{2})(?:[^0-9]|$)"
    found = lambda x, p, use, other: once(F.regexp_extract(x, p, 1), lambda y: F.when(y != "", use(y)).otherwise(other))
    whole = lambda x: F.nullif(F.regexp_extract(x, "([0-9]+)", 1), F.lit(""))
    halves = lambda x: found(x, spaced, lambda y: F.concat(y, F.lit("."), F.regexp_extract(x, spaced, 2)), whole(x))
    return once(F.translate(text, "OОoо", "0000"), lambda x: found(x, r"([0-9]+[.,][0-9]{1,2})", lambda y: F.translate(y, ",", "."), halves(x))).cast("double")


def rescaled(value: Column, reference: Column) -> Column:
    """An amount of 10 or more against a reference below 1, divided by 100, 1000 or 10,000 where that comes near it."""
    out = value
    for scale in (10000.0, 1000.0, 100.0):
        part = value / scale
        out = F.when(F.abs(part - reference) <= F.greatest(F.lit(0.05), F.abs(reference) * 0.25), two_places(part)).otherwise(out)
    return F.when((F.abs(reference) < 1) & (F.abs(value) >= 10), out).otherwise(value)


def date_text(text: Column) -> Column:
    """Dates in figures with two places a part (a time stays), dates in words with one blank between parts, ISO dates as
    they are; other text squeezed."""
    s = squeezed(text)
    low = F.lower(s)
    numeric, words = r"^([0-9]{1,2})\.([0-9]{1,2})\.([0-9]{4})(?: ([0-9]{2}:[0-9]{2}))?$", r"^([0-9]{1,2}) ([а-яё]+) ([0-9]{4}) ?(г\.?)?$"
    part = lambda p, g: F.regexp_extract(low, p, g)
    shown = F.concat(F.lpad(part(numeric, 1), 2, "0"), F.lit("."), F.lpad(part(numeric, 2), 2, "0"), F.lit("."), part(numeric, 3), F.when(part(numeric, 4) != "", F.concat(F.lit(" "), part(numeric, 4))).otherwise(""))
    long = F.concat(part(words, 1).cast("int").cast("string"), F.lit(" "), part(words, 2), F.lit(" "), part(words, 3), F.when(part(words, 4) != "", " г.").otherwise(""))
    return F.when(low.rlike(numeric), shown).when(part(words, 2).isin(*MONTHS), long).when(s == "", F.lit(None)).otherwise(s)


def date_in(text: Column) -> Column:
    """The first date in words or figures inside a text."""
    months = "|".join(MONTHS)
    return F.nullif(F.regexp_extract(F.lower(text), rf"([0-9]{{1,2}} (?:{months}) [0-9]{{4}}|[0-9]{{1,2}}\.[0-9]{{1,2}}\.[0-9]{{4}})", 1), F.lit(""))


def iso_utc(seconds: Column) -> Column:
    """Seconds since 1970 as an ISO time in UTC."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def document_number(text: Column) -> Column:
    """The digits of a document's number: six to eight, of which at least five count unless there are seven."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    significant = F.length(F.regexp_replace(digits, "^0+", ""))
    return F.when(F.length(digits).between(6, 8) & (significant > 0) & ((F.length(digits) == 7) | (significant >= 5)), digits)


def type_name(value: Column) -> Column:
    """The document type that a name stands for; other names in lower case."""
    low = F.lower(value)
    return F.when(low.contains("waybill"), "waybill").when(low.contains("invoice"), "invoice").when(low.contains("payment"), "payment_order").when(low.contains("account"), "account_prot").otherwise(low)


def document_type(summary: Column, wrapper: Column, title: Column, keys: Column, first: Column) -> Column:
    """A document's type from the first source that tells: run summary, wrapper, title, the payload's keys, its first key."""
    title, keys = F.lower(title), F.transform(keys, F.lower)
    by_keys = F.coalesce(*(F.when(F.size(F.array_intersect(keys, F.array(*map(F.lit, need)))) == len(need), kind) for kind, need in TYPE_KEYS))
    return F.coalesce(F.nullif(summary, F.lit("")), type_name(F.nullif(wrapper, F.lit(""))), F.when(title.contains("наклад"), "waybill").when(title.contains("счет"), "invoice"), by_keys, type_name(first), F.lit("unknown"))


def status(summary: Column, has_final: Column, started: Column) -> Column:
    """failed where the run says so, completed with a final payload, processing once work began, else uploaded."""
    return F.when(summary.isNotNull() & (summary != "ok"), "failed").when(has_final, "completed").when(started, "processing").otherwise("uploaded")


def missing(value: Column, kind: T.DataType) -> Column:
    """Whether a value says nothing: null, blank text, an empty list, or a list or struct of nothing but such."""
    if isinstance(kind, T.StringType):
        return value.isNull() | (F.trim(value) == "")
    if isinstance(kind, T.ArrayType):
        return value.isNull() | F.forall(value, lambda x: missing(x, kind.elementType))
    if isinstance(kind, T.StructType):
        inner = F.lit(True)
        for field in kind.fields:
            inner = inner & missing(value[field.name], field.dataType)
        return value.isNull() | inner
    return value.isNull()
