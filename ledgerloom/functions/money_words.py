"""Amounts written out in Russian words, both ways, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the number words of Russian
SMALL = "один два три четыре пять шесть семь восемь девять десять одиннадцать двенадцать тринадцать четырнадцать пятнадцать шестнадцать семнадцать восемнадцать девятнадцать".split()
TENS = "десять двадцать тридцать сорок пятьдесят шестьдесят семьдесят восемьдесят девяносто".split()
HUNDREDS = "сто двести триста четыреста пятьсот шестьсот семьсот восемьсот девятьсот".split()
FEMININE = {"один": "одна", "два": "две"}
SCALES = {1000: ("тысяча", "тысячи", "тысяч"), 1_000_000: ("миллион", "миллиона", "миллионов"), 1_000_000_000: ("миллиард", "миллиарда", "миллиардов")}
ZERO = "ноль"


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _pick(words: list[str], k: Column) -> Column:
    """The k-th word, null for 0."""
    return F.try_element_at(F.array(*map(F.lit, words)), F.nullif(k.cast("int"), F.lit(0)))


def _plural(n: Column, forms: tuple[str, str, str]) -> Column:
    one, few, many = forms
    tail = n % 10
    return F.when((n % 100).between(11, 14), many).when(tail == 1, one).when(tail.between(2, 4), few).otherwise(many)


def _below_1000(n: Column, feminine: bool = False) -> Column:
    small = [FEMININE.get(w, w) if feminine else w for w in SMALL]
    rest = n % 100
    low = rest < 20
    return F.concat_ws(" ", _pick(HUNDREDS, F.floor(n / 100)), F.when(~low, _pick(TENS, F.floor(rest / 10))), _pick(small, F.when(low, rest).otherwise(rest % 10)))


def whole_in_words(n: Column) -> Column:
    """A whole number from 0 to 10**12 - 1 in words; null beyond."""

    def group(n: Column, scale: int) -> Column:
        return _let(F.floor(n / scale) % 1000, lambda k: F.when(k > 0, F.concat_ws(" ", _below_1000(k, scale == 1000), _plural(k, SCALES[scale]))))

    def spelt(n: Column) -> Column:
        parts = [group(n, scale) for scale in sorted(SCALES, reverse=True)]
        rest = _let(n % 1000, lambda k: F.when(k > 0, _below_1000(k)))
        return F.when(n == 0, ZERO).when(n.between(1, 10**12 - 1), F.concat_ws(" ", *parts, rest))

    return _let(n.cast("long"), spelt)


def money_in_words(amount: Column) -> Column:
    """'Сто двадцать руб. 05 коп'; null for null, negative and huge amounts."""

    def written(cents: Column) -> Column:
        capital = _let(whole_in_words(F.floor(cents / 100)), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1000)))
        return F.concat(capital, F.lit(" руб. "), F.lpad((cents % 100).cast("string"), 2, "0"), F.lit(" коп"))

    # the whole part goes its own way, so that large amounts keep their cents as they are
    cents = _let(F.floor(amount), lambda whole: whole * 100 + F.bround((amount - whole) * 100).cast("long"))
    return F.when((amount >= 0) & (amount < 10**12), _let(cents, written))


def _values() -> dict[str, int]:
    found = {ZERO: 0, "одно": 1, "одна": 1, "две": 2}
    for words, step in ((SMALL, 1), (TENS, 10), (HUNDREDS, 100)):
        found |= {w: (k + 1) * step for k, w in enumerate(words)}
    return found | {w: scale for scale, forms in SCALES.items() for w in forms}


VALUES = _values()


def words_to_whole(text: Column) -> Column:
    """The whole number that a text spells; words that are no numbers are passed over; null without any."""
    known = F.create_map(*(F.lit(x) for pair in VALUES.items() for x in pair))
    tokens = F.regexp_extract_all(F.translate(F.lower(text), "ё-", "е "), F.lit("([а-я]+)"), F.lit(1))
    values = F.filter(F.transform(tokens, lambda t: F.try_element_at(known, t).cast("long")), lambda v: v.isNotNull())
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("group"))

    def add(s: Column, v: Column) -> Column:
        scale = v >= 1000
        total = F.when(scale, s["total"] + F.greatest(s["group"], F.lit(1).cast("long")) * v).otherwise(s["total"])
        return F.struct(total.alias("total"), F.when(scale, F.lit(0).cast("long")).otherwise(s["group"] + v).alias("group"))

    return _let(values, lambda found: F.when(F.size(found) > 0, F.aggregate(found, start, add, lambda s: s["total"] + s["group"])))


def words_to_money(text: Column) -> Column:
    """The amount that a text spells: words up to the roubles, figures before 'коп'; null without number words."""

    def read(low: Column) -> Column:
        words = _let(F.regexp_extract(low, r"^(.*?)\s+(?:белорусских\s+)?руб", 1), lambda before: F.when(before != "", before).otherwise(low))
        cents = F.coalesce(F.nullif(F.regexp_extract(low, r"([0-9]{1,2})\s*коп", 1), F.lit("")).cast("int"), F.lit(0))
        return F.round(words_to_whole(words) + cents / 100, 2)

    return _let(F.translate(F.lower(text), "ё", "е"), read)


def needs_rebuild(text: Column, amount: Column) -> Column:
    """Whether a text fails to be the amount in words (case, points and white space aside)."""
    plain = lambda c: F.trim(F.regexp_replace(F.translate(F.lower(c), "ё.", "е"), r"\s+", " "))
    wanted = money_in_words(amount)
    return wanted.isNotNull() & ~F.coalesce(plain(text) == plain(wanted), F.lit(False))
