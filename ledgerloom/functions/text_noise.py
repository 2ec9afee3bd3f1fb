"""Whether recognised text can be relied on: odd symbols, foreign scripts, unknown Latin words, tokens of two scripts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: Latin words that names of goods may hold, symbols and scripts that they don't, letters of other Cyrillic alphabets
LATIN_WORDS = (
    "AQUA ALPHA AMBER ANTI ANTARCTICA BAR BARBER BLACK BLOND BLONDE CLAY CLASSIC COMPLEX COUTURE CREAM CUREX DAR DE DELUXE DYE ESTEL FADEBRUSH GEL GOLD GENWOOD HAIR HAUTE HOMME KERATIN LEADER LEMON LUXURY LUXE MARINE MASK MATTE ML NISHMAN PRO PROFESSIONAL RU "
    "SENSATION SERUM SHAVING SHAMPOO SIZE SPACE SPRAY STORM THERAPY TOP VOLUTE VOLCANO YELLOW"
).split()
BAD_SYMBOLS = "[�ŽžŠšČčĆćŁłĐđĄąĘęŲųŪūĖėİıØøÆæŒœÐðÞþ•·÷▪●○◦■□🐫🤈∴]"
FOREIGN = r"[Ͱ-Ͽ֐-׿؀-ۿ฀-๿₠-⃏←-⇿∀-⋿]"
OTHER_CYRILLIC = "[ІіЇїЄєҐґЈјЊњЉљЋћЌќЂђЅѕЏџ]"
CYRILLIC = "[Ѐ-ӿ]"


def _holds(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(pattern), F.lit(False))


def odd_signs(text: Column) -> Column:
    """Whether a text holds symbols, question marks or scripts that goods are not named with."""
    return _holds(text, BAD_SYMBOLS) | _holds(text, r"[?�]") | _holds(text, FOREIGN)


def unknown_latin(text: Column, known: list[str] = LATIN_WORDS) -> Column:
    """Runs of three Latin letters or more that are no known word, in order."""
    return F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([A-Za-z]{3,})"), F.lit(1)), lambda w: ~F.array_contains(F.array(*map(F.lit, known)), F.upper(w)))


def mixed_tokens(text: Column) -> Column:
    """Tokens of Latin and Cyrillic letters, but for series names with a point or a dash, RU codes and two known names."""
    tokens = F.transform(F.split(F.coalesce(text, F.lit("")), r'[\s,;:()"/\\]+'), lambda t: F.regexp_replace(t, r"^[.,!?%№\-_|]+|[.,!?%№\-_|]+$", ""))
    fine = lambda t: F.upper(t).rlike(r"^[A-Z]{2,}\.[Ѐ-ӿA-Z-]+$") | t.rlike(r"^[A-Z]{2,}-[Ѐ-ӿ-]+$") | F.upper(t).rlike(r"(?U)\bRU(?:\.\d+)+") | F.upper(t).rlike("SENSATION|ALPHA")
    return F.filter(tokens, lambda t: t.rlike(CYRILLIC) & t.rlike("[A-Za-z]") & ~fine(t))


def unreliable_item(text: Column) -> Column:
    """Whether an item's text can't be relied on: odd signs, or several weaker signs together."""
    latin, mixed = F.size(unknown_latin(text)), F.size(mixed_tokens(text))
    marks, other = _holds(text, r"\.{2,}|,{2,}|;{2,}|,\s*\.|\.\s*,"), _holds(text, OTHER_CYRILLIC)
    return odd_signs(text) | _holds(text, CYRILLIC) & marks & (latin >= 2) | other & ((latin >= 2) | (mixed >= 2)) | (mixed >= 3) & (latin >= 1)


def unreliable_strict(text: Column) -> Column:
    """As ``unreliable_item`` for text that should be Cyrillic throughout."""
    latin = F.size(unknown_latin(text))
    return odd_signs(text) | _holds(text, CYRILLIC) & (latin >= 2) | _holds(text, r"\.{3,}|,{2,}|;{2,}") & (latin >= 1)
