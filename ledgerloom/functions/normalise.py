"""Fields of a document brought into one form, by what they are: dates, rates, numbers, accounts, codes, names, addresses.

Each function takes text and gives text, a number or a flag; blank text, "nan", "none" and "null" become null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions import scalars
from ledgerloom.functions.text import once

# fixed values: the mark of a field in doubt, look-alike letters, quotation marks, labels of parties, units and what they are called
MARKER = "проверить поле"
CYRILLIC, LATIN = "АВСЕНКМОРТУХІҮаеорсух", "ABCEHKMOPTYXIYaeopcyx"
QUOTES, PLAIN_QUOTES = "«»“”„’‘", "\"\"\"\"\"''"
PARTY_LABELS = "Организация|Поставщик|Покупатель|Плательщик|Бенефициар|Грузоотправитель|Грузополучатель"
UNITS = {"шт": ("шт", "шτ", "шп", "sp", "pc", "pcs", "iuit", "juit", "wr", "w"), "уп": ("уп", "упак", "упаковка")}
MEASURES = "мл|г|кг|л|см|мм|шт|м|мкм"
#: Words of rows that are totals, not items.
TOTAL_NAMES = ("итого", "итог", "итого:")


def said(text: Column) -> Column:
    """Squeezed text; null where it says nothing."""
    return once(scalars.squeezed(text), lambda s: F.when(~F.lower(s).isin("", "nan", "none", "null"), s))


def in_doubt(text: Column) -> Column:
    return F.coalesce(F.lower(scalars.squeezed(text)) == MARKER, F.lit(False))


def _latin(text: Column) -> Column:
    return F.translate(text, CYRILLIC, LATIN)


def _digits(text: Column) -> Column:
    """Letters that stand for digits as digits, a comma as a point."""
    return F.translate(_latin(text), "OОІIL,", "00111.")


def _edges(text: Column, marks: str = " ,;:") -> Column:
    return once(F.regexp_replace(scalars.squeezed(text), f"^[{marks}]+|[{marks}]+$", ""), lambda s: F.when(s != "", s))


def _steps(text: Column, *steps: tuple[str, str]) -> Column:
    for pattern, by in steps:
        text = F.regexp_replace(text, pattern, by)
    return text


def plain(text: Column) -> Column:
    """Text without markup and loose marks at its ends, with simple quotation marks and no blank before a mark."""
    return _edges(_steps(F.translate(said(text), QUOTES, PLAIN_QUOTES), (r"<[^>]+>", " "), (r"\s+([,.;:])", "$1")))


def free(text: Column) -> Column:
    return _edges(_steps(plain(text), (r"(?iU)\bДата документа:?\s*$", "")))


def address(text: Column) -> Column:
    """A house number's letter is Cyrillic: 6a -> 6а."""
    return _edges(_steps(plain(text), (r"([0-9])\s*[aA](?![\p{L}0-9_])", "$1а")))


def bank_name(text: Column) -> Column:
    """Without "в банке" before it, and without its codes."""
    return _edges(_steps(plain(text), (r"(?iu)^\s*в банке\s+", ""), (r"(?iU)\b(?:БИК|BIC|Код банка)\b.*$", ""), (r"(?U)\b[A-Z]{6}[A-Z0-9]{2}\b", " ")))


def party_name(text: Column) -> Column:
    """Without its label; words of a company's form that recognition cut in two are joined."""
    return _edges(_steps(plain(text), (rf"(?iu)^\s*(?:{PARTY_LABELS})\s*:?\s*", ""), (r"(?iU)\bограниченно\s+й\b", "ограниченной"), (r"(?iU)\bо\s+тветственностью\b", "ответственностью")))


def unit(text: Column) -> Column:

    def named(s: Column) -> Column:
        out = F.when(s == "", F.lit(None).cast("string"))
        for name, written in UNITS.items():
            out = out.when(s.isin(*written), name)
        return out.otherwise(s)

    return once(F.regexp_replace(F.replace(F.lower(plain(text)), F.lit("."), F.lit("")), r"\s+", ""), named)


def product(text: Column) -> Column:
    """A point before a measure or a long number is a comma; commas are followed by one blank."""
    return _edges(_steps(plain(text), (rf"(?U)\.\s+(?=[0-9]+\s*(?:{MEASURES})\b|[0-9]{{8,14}}\b)", ", "), (r"\s*,\s*", ", ")), " ,.;:")


def money_words(text: Column) -> Column:
    return _edges(_steps(plain(text), (r"(?iU)\bкопейк\b", "копейки"), (r"(?iU)(?<=[0-9])\s*руб\b\.?", " руб."), (r"(?iU)(?<=[0-9])\s*коп\b\.?", " коп.")), " ,.;:")


def number(text: Column) -> Column:
    """A number to two places; null where none can be read."""
    return scalars.two_places(F.regexp_replace(_digits(said(text)), r"[^0-9.\-]", "").try_cast("double"))


def whole(text: Column) -> Column:
    """A whole number, halves to the even one; null where none can be read."""
    return F.bround(F.regexp_replace(_digits(said(text)), r"[^0-9.\-]", "").try_cast("double")).cast("long")


def percent(text: Column) -> Column:
    """'20%' or '12.5%'; text without a number as it is."""
    s = F.replace(F.replace(_digits(said(text)), F.lit("％"), F.lit("%")), F.lit(" "), F.lit(""))
    shown = lambda n: F.when(n == F.floor(n), F.floor(n).cast("string")).otherwise(n.cast("string"))
    found = once(scalars.two_places(F.regexp_extract(s, r"(-?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")), shown)
    return F.coalesce(F.concat(found, F.lit("%")), said(text))


def account(text: Column) -> Column:
    return F.translate(F.regexp_replace(F.upper(_latin(said(text))), r"\s+", ""), "OОІIL", "00111")


def code(text: Column) -> Column:
    return F.regexp_replace(F.upper(_latin(said(text))), r"\s+", "")


def phone(text: Column) -> Column:
    """Twelve digits that begin with 375 as +375...; other numbers squeezed."""
    digits = F.regexp_replace(said(text), "[^0-9]", "")
    return F.when(digits.rlike("^375[0-9]{9}$"), F.concat(F.lit("+"), digits)).otherwise(said(text))


def email(text: Column) -> Column:
    return F.lower(said(text))
