"""Secrets in texts: exact base rules, and strings whose characters are as good as random.

Everything runs as SQL expressions, a row at a time. Further candidates are long runs of the characters that keys are
written in. A window slides over each; counts of its characters change by the one that enters and the one that leaves,
and so does its Shannon entropy, which is held against the limit of the window's character class. Strings known to be
no secrets (digests, identifiers, placeholders, addresses) are suppressed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.pii import _matches, _merge, _once

KINDS = ("assign", "access", "hex")
# fixed values: the base rules. What cannot give back characters is possessive, a run that is long enough is asked for
# at once where a failing match would take all of its run; neither changes what matches.
ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?+\x20*+[:=]\x20*+[\"']?+([A-Za-z0-9+/_.=-]++)"
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
ASSIGN_LEAST = 6
#: Further candidates: runs of what keys are written in, with padding.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}+"
ALPHABET = "0123456789abcdefABCDEFghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ+/_-="
#: Characters of a window; a candidate is looked at in stretches of so many windows, so that a long one takes no more memory.
WINDOW, STRETCH = 20, 4096
#: Entropies are kept in whole numbers of this fraction of a bit, so that a sum does not depend on its order.
UNIT = 1 << 20


@dataclass(frozen=True)
class Limit:
    """What a window of a character class must reach: bits of entropy, changes between digits, small, capital and other characters."""

    bits: float
    changes: int

    @property
    def most(self) -> int:
        """The greatest sum of n * log2(n) over the counts of characters, in UNITs: the entropy is log2(WINDOW) - sum / WINDOW."""
        return math.floor((math.log2(WINDOW) - self.bits) * WINDOW * UNIT)


#: By class: hexadecimal digits only (both letters and digits), letters of one case with digits and marks, both cases.
LIMITS = {"hex": Limit(3.0, 5), "one": Limit(3.4, 6), "both": Limit(3.6, 6)}
#: Suppressed, by the candidate itself: identifiers in five groups, placeholders, sequences, words in a path or joined by marks.
ALLOWED = (
    r"^[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
    r"(?i)example|sample|dummy|changeme|placeholder|your[_-]?(?:key|token|secret|api|pass)|x{5}|(.)\1{7}",
    r"(?i)0123456789|1234567890|abcdefgh|qwertyui",
    r"^/?(?:[A-Z]?[a-z]+[0-9]{0,4}|[A-Z]+[0-9]{0,4}|[0-9]{1,4})(?:[/_-]+(?:[A-Z]?[a-z]+[0-9]{0,4}|[A-Z]+[0-9]{0,4}|[0-9]{1,4}))+/?$",
)
#: Suppressed, by what stands before: names of digests and revisions, data written out in base 64, web addresses.
ALLOWED_AFTER = r"(?i)(?:\b(?:sha-?(?:1|224|256|384|512)|md5|crc32|checksum|digest|fingerprint|etag|integrity|commit|revision|uuid)\b\W{0,3}|;base64,|\b(?:https?|ftp|file|s3):|://\S*)$"



def _none() -> Column:
    return F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")


def base_spans(text: Column) -> Column:
    """array<struct<start, kind number, end>> of the base rules, in order of start and kind."""
    any_case = F.lower(text)
    checks = (
        (ASSIGN, any_case.rlike("passw|secret|token|api_?key"), lambda w: F.length(F.regexp_extract(w, ASSIGN, 1)) >= ASSIGN_LEAST),
        (ACCESS, text.contains("AKIA"), None),
        (HEX, F.lit(True), None),
    )
    parts = []
    for k, (pattern, maybe, good) in enumerate(checks):
        found = F.when(maybe, _matches(text, pattern))
        found = F.filter(found, lambda m: good(m["word"])) if good else found  # noqa: B023
        parts.append(F.coalesce(F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), (m["start"] + F.length(m["word"])).alias("end"))), _none()))  # noqa: B023
    return F.array_sort(F.concat(*parts))


def _later(values: Column, n: int) -> Column:
    """What stood ``n`` places before, 0 at the start."""
    return F.slice(F.concat(F.array_repeat(F.lit(0), n), values), F.lit(1), F.size(values))


def _random_windows(stretch: Column) -> Column:
    """Whether any window of a string of ALPHABET reaches the limit of its class: one step for each character.

    A step adds what enters the window and takes away what leaves it: counts of characters, the sum of n * log2(n) over
    them, counts of kinds of characters and of changes between these.
    """
    places = F.transform(F.split(stretch, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    digit, hexadecimal = lambda k: k.between(1, 10), lambda k: k.between(11, 22)
    small, capital = lambda k: k.between(11, 16) | k.between(23, 42), lambda k: k.between(17, 22) | k.between(43, 62)
    kind = lambda k: F.when(digit(k), 1).when(small(k), 2).when(capital(k), 3).otherwise(4)
    log = lambda n: F.element_at(F.array(*(F.lit(round(m * math.log2(m) * UNIT) if m else 0).cast("long") for m in range(WINDOW + 1))), n + 1)
    changed = lambda ks: F.zip_with(ks, _later(ks, 1), lambda k, was: ((was > 0) & (kind(k) != kind(was))).cast("int"))
    pair = lambda x, y, names: F.zip_with(x, y, lambda u, v: F.struct(u.alias(names[0]), v.alias(names[1])))
    both = lambda ks: _once(changed(ks), lambda ch: pair(pair(ks, ch, ("k", "ch")), pair(_later(ks, WINDOW), _later(ch, WINDOW - 1), ("k", "ch")), ("in", "out")))
    moves = _once(places, both)
    kinds = {"digits": digit, "hexadecimal": hexadecimal, "small": small, "capitals": capital}
    nothing = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0).cast("long").alias("sum"), *(F.lit(0).alias(x) for x in ("seen", "changes", *kinds)), F.lit(False).alias("good"))

    def step(s: Column, m: Column) -> Column:
        k, k0 = m["in"]["k"], m["out"]["k"]
        count = lambda at: F.coalesce(F.get(s["counts"], at - 1), F.lit(0))
        gone = F.when(k0 > 0, log(count(k0) - 1) - log(count(k0))).otherwise(F.lit(0).cast("long"))
        new = F.struct(
            F.transform(s["counts"], lambda n, i: n + (i + 1 == k).cast("int") - (i + 1 == k0).cast("int")).alias("counts"),
            F.when(k == k0, s["sum"]).otherwise(s["sum"] + log(count(k) + 1) - log(count(k)) + gone).alias("sum"),
            (s["seen"] + 1).alias("seen"), (s["changes"] + m["in"]["ch"] - m["out"]["ch"]).alias("changes"),
            *((s[x] + is_(k).cast("int") - is_(k0).cast("int")).alias(x) for x, is_ in kinds.items()), s["good"].alias("good"),
        )
        fits = lambda n, c: (n["sum"] <= LIMITS[c].most) & (n["changes"] >= LIMITS[c].changes)
        of_class = lambda n: F.when(n["digits"] + n["hexadecimal"] == WINDOW, (n["digits"] > 1) & (n["hexadecimal"] > 1) & fits(n, "hex")).when((n["small"] == 0) | (n["capitals"] == 0), (n["digits"] > 1) & fits(n, "one")).otherwise(fits(n, "both"))
        return _once(new, lambda n: F.struct(*(n[x].alias(x) for x in ("counts", "sum", "seen", "changes", *kinds)), (n["good"] | (n["seen"] >= WINDOW) & of_class(n)).alias("good")))

    return F.aggregate(moves, nothing, step, lambda s: s["good"])


def _as_random(word: Column) -> Column:
    """Whether any window of a candidate is as good as random. Stretches overlap by all but one character of a window."""
    plain = F.encode(word, "UTF-8")
    cut = lambda k: F.decode(F.substring(plain, k * STRETCH + 1, F.lit(STRETCH + WINDOW - 1)), "UTF-8")
    return F.exists(F.sequence(F.lit(0), F.floor((F.octet_length(word) - 1) / STRETCH).cast("int")), lambda k: _random_windows(cut(k)))


def _any(word: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | word.rlike(p)
    return out


def further_spans(text: Column) -> Column:
    """array<struct<start, kind number, end>> of candidates as good as random and not suppressed.

    Those of hexadecimal digits alone count as hex, all others as access: keys without a prefix known to the rules.
    """
    good = F.filter(_matches(text, CANDIDATE), lambda m: ~(_any(m["word"], ALLOWED) | m["before"].rlike(ALLOWED_AFTER)) & _as_random(m["word"]))
    kind = lambda w: F.when(w.rlike("^[0-9A-Fa-f]+$"), 2).otherwise(1)
    return F.coalesce(F.transform(good, lambda m: F.struct(m["start"].alias("start"), kind(m["word"]).alias("kind"), (m["start"] + F.length(m["word"])).alias("end"))), _none())


def find(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` (it has text) with base and spans: array<struct<start, kind, end>> each.

    base follows the fixed rules; spans adds candidates of high entropy that overlap no base span. Offsets count code
    points, ends are exclusive. A null or empty text has none; columns of these names that ``docs`` has already give
    way. Work is a row at a time and in proportion to the text and its matches, however long either is: repeated rows,
    ties, nulls in other columns and empty tables need no rule.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.drop("base", "spans").withColumn("base", base_spans(text))
    found = F.when(text.rlike(CANDIDATE), _once(further_spans(text), lambda more: _merge(F.col("base"), more)))
    return docs.withColumn("spans", F.coalesce(found, F.col("base")))


def render(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
