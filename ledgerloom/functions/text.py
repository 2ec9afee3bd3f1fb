"""Text as recognition leaves it: markup, white space, look-alike letters, noise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: Cyrillic capitals and the Latin capitals they look like
LOOKALIKES = ("АВЕКМНОРСТУХ", "ABEKMHOPCTYX")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def clean_inline(text: Column) -> Column:
    """White space, no-break blanks included, becomes one blank; blank text becomes null."""
    return F.nullif(squeezed_inline(text), F.lit(""))


def squeezed_inline(text: Column) -> Column:
    """As ``clean_inline``, but blank text becomes the empty one."""
    # single blanks are what they should be: most texts hold nothing to replace
    return F.trim(F.regexp_replace(text, "[ \\t\\r\\n\\x0b\\f\\u00a0]{2,}|[\\t\\r\\n\\x0b\\f\\u00a0]", " "))


def strip_markup(text: Column) -> Column:
    return clean_inline(F.regexp_replace(text, "<[^>]*>", " "))


def collapse_marks(text: Column) -> Column:
    """Runs of the same mark become one."""
    out = text
    for mark in ".,;:!?-":
        out = F.regexp_replace(out, f"[{mark}]{{2,}}", mark)
    return out


def latin_lookalikes(text: Column) -> Column:
    return F.translate(F.upper(text), *LOOKALIKES)


def significant_tokens(text: Column, least: int = 4, most: int = 8) -> Column:
    """The first distinct lower-case words of some length, in order; a display limit of the operator itself."""
    words = F.regexp_extract_all(F.lower(text), F.lit(f"[a-z]{{{least},}}"), F.lit(0))
    return F.slice(F.array_distinct(words), 1, most)


def normalise_date(text: Column) -> Column:
    """d.m.yyyy with leading zeros; ISO dates and other text stay as they are."""
    part = lambda i: F.regexp_extract(text, r"^([0-9]{1,2})\.([0-9]{1,2})\.([0-9]{4})$", i)
    return F.when(part(3) != "", F.concat_ws(".", F.lpad(part(1), 2, "0"), F.lpad(part(2), 2, "0"), part(3))).otherwise(clean_inline(text))


def noise(text: Column) -> Column:
    """Flags of doubtful text: few letters, long runs of one character, mostly capitals."""
    letters = F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]", ""))
    return F.struct((2 * letters < F.length(text)).alias("few_letters"), text.rlike("(aaaa|eeee|!!!|[.]{4})").alias("runs"), ((letters > 0) & (2 * capitals > letters)).alias("shouting"))


def keyword_score(text: Column, words: dict[str, int]) -> Column:
    """Sum of the weights of the words that a text holds."""
    return sum((F.when(F.lower(text).contains(w), F.lit(n)).otherwise(F.lit(0)) for w, n in words.items()), F.lit(0))


def field_state(value: Column, marker: str) -> Column:
    """null, review, invalid, empty or ok, in this order."""
    v = F.trim(F.lower(value))
    return F.when(value.isNull(), "null").when(v == marker, "review").when(v.isin("nan", "none", "null"), "invalid").when(v == "", "empty").otherwise("ok")


#: Characters that stand for single bytes above 127 in Windows-1251, and the Latin-1 characters of those bytes.
_BYTES = [(bytes([b]).decode("cp1251"), chr(b)) for b in range(128, 256) if b != 0x98]
_CP1251, _LATIN1 = "".join(a for a, _ in _BYTES), "".join(b for _, b in _BYTES)
# fixed values: what UTF-8 read as a one-byte code looks like
BROKEN = ("Р", "С", "вЂ", "в„", "Ð", "Ñ")


def _damage(text: Column) -> Column:
    """How broken a text looks: replacement characters count five, marks of wrong decoding one."""
    times = lambda m: (F.length(text) - F.length(F.replace(text, F.lit(m), F.lit("")))) / len(m)
    return sum((times(m) for m in BROKEN), 5 * times("�"))


def _reread(text: Column) -> Column:
    """The text as UTF-8 if its Windows-1251 bytes are that, else null."""
    fits = text.rlike("^[\\x00-\\x7f" + "".join(f"\\u{ord(ch):04x}" for ch in _CP1251) + "]*$")
    raw = F.encode(F.translate(F.when(fits, text), _CP1251, _LATIN1), "ISO-8859-1")
    return F.try_validate_utf8(raw.cast("string"))


def repair_encoding(text: Column) -> Column:
    """Undo up to two wrong decodings of UTF-8 as Windows-1251; the least broken reading wins, the earlier at ties."""
    once = _reread(text)
    tries = F.array(*(F.struct(_damage(v).alias("damage"), F.lit(k).alias("k"), v.alias("v")) for k, v in enumerate((text, once, _reread(once)))))
    return F.array_min(F.filter(tries, lambda t: t.v.isNotNull())).v


def trim_edge_noise(text: Column) -> Column:
    """Drop words without a letter or digit from both ends."""
    words = F.split(F.coalesce(clean_inline(text), F.lit("")), " ")
    solid = F.transform(words, lambda w: w.rlike(r"[\p{L}\p{N}]"))
    first, last = F.array_position(solid, True), F.array_position(F.reverse(solid), True)
    n = F.greatest(F.lit(0), F.size(words) - first.cast("int") - last.cast("int") + 2)
    return F.when(first > 0, F.array_join(F.slice(words, F.greatest(first.cast("int"), F.lit(1)), n), " "))


def clean_or_review(text: Column, doubtful: Column, marker: str) -> Column:
    """Clean text; the marker where it is doubtful (or already the marker); null where it is blank."""
    clean = clean_inline(text)
    return F.when(clean.isNull(), F.lit(None).cast("string")).when((clean == marker) | F.coalesce(doubtful, F.lit(False)), marker).otherwise(clean)


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def account_number(text: Column) -> Column:
    """The first account of the form BY, two digits, 24 letters or digits, blanks inside allowed."""
    return _found(F.regexp_replace(latin_lookalikes(text), r"\s+", ""), "(BY[0-9]{2}[A-Z0-9]{24})")


def bank_codes(text: Column) -> Column:
    """All distinct bank codes (four letters, BY, two and perhaps three more signs), in order."""
    return F.array_distinct(F.regexp_extract_all(latin_lookalikes(text), F.lit(r"\b([A-Z]{4}BY[A-Z0-9]{2}(?:[A-Z0-9]{3})?)\b"), F.lit(1)))


def tax_ids(text: Column) -> Column:
    """All distinct numbers of exactly nine digits, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?<![0-9])([0-9]{9})(?![0-9])"), F.lit(1)))


def between(text: Column, start: str, stops: list[str]) -> Column:
    """Clean text after the first match of ``start`` up to the nearest of ``stops``, or the end."""
    after = F.regexp_extract(text, f"(?isuU){start}(.*)$", 1)
    return clean_inline(_found(after, f"(?isuU)^(.*?)(?:{'|'.join([*stops, '$'])})"))


def page_stem(page_id: Column) -> Column:
    return F.regexp_replace(page_id, r"__p\d+$", "")


def page_number(page_id: Column) -> Column:
    return _found(page_id, r"__p(\d+)$").cast("int")


def split_cells(line: Column) -> Column:
    """Cells of a line that are parted by bars."""
    return F.split(F.trim(line), r"\s*\|\s*")


def size_text(n: Column) -> Column:
    """Bytes for people: B, KB, MB or GB with one decimal."""
    shown = lambda div, unit: F.format_string(f"%.1f {unit}", n / F.lit(float(div)))
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1024**2, shown(1024, "KB")).when(n < 1024**3, shown(1024**2, "MB")).otherwise(shown(1024**3, "GB"))
