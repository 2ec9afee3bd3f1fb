"""Parties of documents: sections of lines between anchors, company names and addresses in them, and the best of several readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import clean_inline, strip_markup
from ledgerloom.operators.amounts import _computed

c = F.col
# fixed values: forms of companies, words of addresses, labels of forms, anchors of an invoice's head
FORMS = ("Общество с ограниченной ответственностью", "ООО", "ОДО", "ОСО", "ОАО", "ЗАО", "УП", "РУП", "ЧУП", "ИП")
QUOTED_FORMS = ("ООО", "ОАО", "ЗАО", "ОДО", "ЧУП", "Общество с ограниченной ответственностью", "Открытое акционерное общество", "Закрытое акционерное общество")
ADDRESS_WORDS = r"(?iu)(?:^|[\s,])(?:ул\.|пр\.|пр-?т|г\.|район|р-н|каб\.|пом\.|Беларусь|обл\.)(?=$|[\s,])"
SCORED_ADDRESS_WORDS = r"(?iu)(?:^|[\s,])(?:ул\.|пр\.|г\.|р-н|каб\.|пом\.|Беларусь|обл\.)(?=$|[\s,])"
ANCHOR_NOISE = r"(?iU)Гр\S{0,12}(?:отправ|получ)\w*|Груз\w*(?:отправ|получ)\w*|Осн\w*\s+\S*пуск\w*|Основание\s+отпуска|Пункт\s+(?:погрузки|разгрузки)|\(наим|\(адр|наимин|адрос|овиние"
PLACES = r"(?iU)\b(?:Беларусь|Минск|обл\.?|район|р-н|ул\.?|пр\.?|д\.?|дом|пом\.?|оф\.?|каб\.?|корп\.?|индекс|\d{6})\b"
NO_NAME, NO_ADDRESS = r"(?iU)\b(?:Поставщик|Покупатель|Основание|Организация|тел\.?|УНП|КПП|БИК|р/с|в банке)\b", r"(?iU)\b(?:Поставщик|Покупатель|Основание|Организация|УНП|УПП|КПП|БИК|р/с|в банке|тел\.?)\b"
ANCHORS = r'(?iu)(?:^|(?<=[\s,;:"«»]))(?:Поставщик|Покупатель|Основание|Организация)\s*:?\s*'
NUMBER, ORGANISATION, SUPPLIER, CUSTOMER, GROUND = r"Счет\s*№", "Организация:", "Поставщик:", "Покупатель:", "Основание:"
_QUOTED = rf'(?iu)((?:{"|".join(QUOTED_FORMS)})\s*["«][^"»]+["»])'
_FORM = rf"(?iU)\b(?:{'|'.join(sorted(FORMS, key=len, reverse=True))})\b"


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _holds(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(pattern), F.lit(False))


def sections(lines: DataFrame, key: str, wanted: dict[str, tuple[str, tuple[str, ...]]]) -> DataFrame:
    """key and, for each name, the text from its start anchor up to the first later line with one of its end anchors; null
    where the start is missing. A line that begins with the anchor goes before one that holds it further on.

    Where each section begins and ends is known from running minima over the document's lines; texts are gathered at the end.
    """
    w = Window.partitionBy(key)
    df = lines.select(key, "line_no", clean_inline(c("line")).alias("line")).filter("line is not null")
    first = lambda cond: F.min(F.when(cond, c("line_no"))).over(w)
    df = df.withColumns({f"_s_{n}": F.coalesce(first(_holds(c("line"), rf"(?iU)^\s*(?:{start})")), first(_holds(c("line"), rf"(?iU)(?:{start})"))) for n, (start, _) in wanted.items()})
    df = _computed(df)
    df = _computed(df.withColumns({f"_e_{n}": first((c("line_no") > c(f"_s_{n}")) & _holds(c("line"), "(?iU)" + "|".join(f"(?:{e})" for e in ends))) for n, (_, ends) in wanted.items()}))
    out = {}
    for n, (start, _) in wanted.items():
        part = F.when(c("line_no") == c(f"_s_{n}"), F.regexp_extract("line", rf"(?iU)((?:{start}).*)$", 1)).otherwise(c("line"))
        inside = (c("line_no") >= c(f"_s_{n}")) & F.coalesce(c("line_no") < c(f"_e_{n}"), F.lit(True))
        held = F.array_sort(F.collect_list(F.when(inside, F.struct("line_no", part.alias("part")))))
        out[n] = clean_inline(F.array_join(F.transform(held, lambda x: x["part"]), " "))
    return df.groupBy(key).agg(*(v.alias(n) for n, v in out.items()))


def bare(text: Column) -> Column:
    """Text without markup, without the anchors of a head and without notes on what a field is for."""
    out = F.regexp_replace(F.regexp_replace(strip_markup(text), ANCHORS, " "), r"(?iu)\(\s*наименование.*?\)", " ")
    return clean_inline(F.regexp_replace(F.regexp_replace(out, r"\s+", " "), r"\s+([,;:])", "$1"))


def company(text: Column) -> Column:
    """The longest name of a form and quoted words, the first of equal ones; null without one."""
    return _longest(bare(text))


def _longest(text: Column) -> Column:
    names = F.transform(F.regexp_extract_all(text, F.lit(_QUOTED), F.lit(1)), clean_inline)
    good = F.filter(names, lambda n: ~n.rlike(NO_NAME))
    ranked = F.array_sort(F.transform(good, lambda n, i: F.struct((-F.length(n)).alias("n"), i.alias("i"), n.alias("name"))))
    return F.try_element_at(ranked, F.lit(1))["name"]


def address(text: Column) -> Column:
    """An address without tax numbers, and without what follows a telephone, an account or a bank."""
    out = F.regexp_replace(strip_markup(text), r"^\s*[,;:]+\s*", "")
    for pattern, by in ((r"(?iU)\b(?:УНП|УПП|КПП)\s*\d{9}\b", " "), (r"(?iU)\bтел\.?\s*:?.*$", " "), (r"(?iU)\bр/с\b.*$", " "), (r"(?iU)\bв банке\b.*$", " "), (r"^([0-9]{6})\s*,\s*\1\b", "$1"), (r"\s+", " "), (r"\s+([,;:])", "$1"), (r"^[ ,;:]+|[ ,;:]+$", "")):
        out = F.regexp_replace(out, pattern, by)
    return clean_inline(out)


def plausible_address(text: Column) -> Column:
    clean = strip_markup(text)
    return F.coalesce(~clean.startswith(",") & ~clean.rlike(NO_ADDRESS) & ~clean.rlike(_QUOTED) & (F.length(clean) >= 10) & clean.rlike(PLACES), F.lit(False))


def _with_parties(df: DataFrame, names: list[str]) -> DataFrame:
    """Columns ``_name`` with a struct (name, tax_id, address) of each section's text, step by step."""
    payload = lambda t: bare(F.regexp_replace(F.regexp_replace(t, r"(?iu)^.*?(?:Поставщик|Покупатель|Организация):\s*", ""), r"(?iU)\b(?:УНП|КПП)\s*\d{9}\b\s*,?\s*", " "))
    df = _computed(df.withColumns({f"_b_{n}": bare(c(n)) for n in names} | {f"_p_{n}": payload(c(n)) for n in names}))
    df = _computed(df.withColumns({f"_n_{n}": _longest(c(f"_b_{n}")) for n in names}))
    at = lambda n: F.instr(f"_p_{n}", c(f"_n_{n}"))
    df = _computed(df.withColumns({f"_a_{n}": F.when(at(n) > 0, F.substr(f"_p_{n}", at(n) + F.length(f"_n_{n}"))).otherwise(c(f"_p_{n}")) for n in names}))
    df = _computed(df.withColumns({f"_a_{n}": address(c(f"_a_{n}")) for n in names}))
    tax = lambda t: F.coalesce(_found(t, r"(?iU)УНП\s*:?\s*(\d{9})"), _found(t, r"(?<![0-9])([0-9]{9})(?![0-9])"))
    df = df.withColumns({f"_{n}": F.struct(c(f"_n_{n}").alias("name"), tax(c(n)).alias("tax_id"), F.when(plausible_address(c(f"_a_{n}")), c(f"_a_{n}")).alias("address")) for n in names})
    return _computed(df.drop(*(f"_{x}_{n}" for x in "bpna" for n in names)))


def invoice_parties(lines: DataFrame, key: str) -> DataFrame:
    """key, supplier and customer (name, tax_id, address; the customer's kpp and phone) of invoices from their lines.

    The supplier is read from the section of the organisation, else from its own: the first that says anything counts.
    """
    ends = (NUMBER, ORGANISATION)
    wanted = {"organisation": (ORGANISATION, (NUMBER, r"УНП\b", SUPPLIER, CUSTOMER, GROUND)), "supplier": (SUPPLIER, (CUSTOMER, GROUND)), "customer": (CUSTOMER, (GROUND, *ends))}
    df = _with_parties(_computed(sections(lines, key, wanted)), list(wanted))
    said = lambda p: F.coalesce(c(f"{p}.name"), c(f"{p}.tax_id"), c(f"{p}.address")).isNotNull()
    phone = clean_inline(_found(c("customer"), r"(\+[0-9][0-9()\-\s]{7,}[0-9]|\([0-9]{2,4}\)\s*[0-9][0-9\-\s]{5,}[0-9])"))
    supplier = F.when(said("_organisation"), c("_organisation")).when(said("_supplier"), c("_supplier"))
    customer = F.struct("_customer.name", "_customer.tax_id", "_customer.address", _found(c("customer"), r"(?iU)КПП\s*(\d{9})").alias("kpp"), phone.alias("phone"))
    return df.select(key, supplier.alias("supplier"), F.when(c("customer").isNotNull(), customer).alias("customer"))


def address_only(text: Column) -> Column:
    """Whether a text is an address without the form of a company."""
    return _holds(text, ADDRESS_WORDS) & ~_holds(text, _FORM)


def anchor_noise(text: Column) -> Column:
    """Whether a text holds labels of the form, read well or badly."""
    return _holds(text, ANCHOR_NOISE)


def party_score(text: Column) -> Column:
    """How much a text says of a party: its length, more with a form or an address, less for copies' marks or few words."""
    clean = clean_inline(text)
    few = F.size(F.split(clean, " ")) < 3
    score = F.length(clean) - F.when(_holds(text, r"(?iU)\b[1-4]-й\s+экз"), 500).otherwise(0) + F.when(_holds(text, _FORM), 100).otherwise(0) + F.when(_holds(text, SCORED_ADDRESS_WORDS), 25).otherwise(0) - F.when(few, 50).otherwise(0)
    return F.coalesce(score, F.lit(-10_000))


def best_party_text(candidates: DataFrame, keys: list[str], text: str, order: str) -> DataFrame:
    """keys, text, score: of several readings of a party the one of the highest score, the first in order of equal ones."""
    scored = candidates.select(*keys, c(text).alias("text"), party_score(c(text)).alias("score"), c(order).alias("_order"))
    best = scored.groupBy(*keys).agg(F.max_by(F.struct("text", "score"), F.struct(c("score"), -c("_order"))).alias("b"))
    return best.select(*keys, "b.text", "b.score")


def confident(name: Column, place: Column) -> Column:
    """Whether a name can be taken as it is: no address, and a company's form in it, or an address beside three words or more."""
    clean = clean_inline(name)
    place_word = _holds(name, r"(?iU)\b(?:c/c|с/с|р-н|ул\.|дом|пом\.|каб\.)(?!\w)")
    return F.coalesce(clean.isNotNull() & ~address_only(clean) & ~place_word & (_holds(name, _FORM) | clean_inline(place).isNotNull() & (F.size(F.split(clean, " ")) >= 3)), F.lit(False))


def name_and_address(text: Column) -> Column:
    """struct(name, address): a form with quoted words and what follows, else what stands before and behind the first comma."""
    clean = F.regexp_replace(text, r"^\([^)]*\)\s*", "")
    for note in ("наим", "адрес"):
        clean = F.regexp_replace(clean, rf"(?iu)\(\s*{note}[^)]*\)", " ")
    clean = F.nullif(F.regexp_replace(F.regexp_replace(clean, r"\s+", " "), "^[ ,;]+|[ ,;]+$", ""), F.lit(""))
    pattern = lambda form: rf'(?iu)^(?:.*?)({form}\s+[«"][^»"]+[»"])[ ,;]*(.*)$'
    name, rest = F.coalesce(*(_found(clean, pattern(f)) for f in FORMS)), F.coalesce(*(F.when(_holds(clean, pattern(f)), F.regexp_extract(clean, pattern(f), 2)) for f in FORMS))
    comma = clean.contains(",") & name.isNull()
    return F.struct(F.when(comma, clean_inline(F.substring_index(clean, ",", 1))).otherwise(F.coalesce(clean_inline(name), clean)).alias("name"), F.when(comma, clean_inline(F.regexp_extract(clean, r"^[^,]*,(.*)$", 1))).otherwise(clean_inline(rest)).alias("address"))


def person_and_rest(text: Column) -> Column:
    """struct(person, rest): what ends in initials, and what follows; all of it and null where there are none."""
    clean = clean_inline(text)
    person = _found(clean, r"^(.*?(?<!\p{L})\p{L}\.\p{L}\.)\s+(.*)$")
    return F.struct(F.coalesce(clean_inline(person), clean).alias("person"), F.when(person.isNotNull(), clean_inline(F.regexp_extract(clean, r"^(.*?(?<!\p{L})\p{L}\.\p{L}\.)\s+(.*)$", 2))).alias("rest"))
