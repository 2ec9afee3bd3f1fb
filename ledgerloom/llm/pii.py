"""Personal data in texts: exact base rules, and boosted trees that judge further candidates.

Everything runs as SQL expressions. Generators propose overlapping spans, expressions describe their form and
the words before them, boosted trees (fitted on a bounded generated sample, written out as CASE expressions)
score them, and a threshold for each kind, set on rows held out from fitting, selects.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
# fixed values: the base rules. A part of a pattern that cannot give back characters is possessive, and a
# match can only begin where a run begins or the last match ended; neither changes what matches.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?<![0-9][0-9])(?<![0-9][ -][0-9])(?:[ -]?+[0-9]){11,}+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: Further candidates: (kind, pattern). They propose far more than is personal data, and their spans overlap; the trees judge.
GENERATORS = (
    ("email", r"[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}) ?[A-Za-z0-9-]{2,63}+){1,4}"),
    ("ip", r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{0,4}+(?::[0-9A-Fa-f]{0,4}+){2,7}+(?![0-9A-Za-z:])"),
    ("card", r"(?<![0-9A-Za-z.-])[0-9]{4}(?:[ ._/*-]{1,3}[0-9]{4}){2}[ ._/*-]{1,3}[0-9]{1,7}(?![0-9A-Za-z])"),
    ("phone", r"(?<![0-9A-Za-z.+-])(?:\([0-9]{2,5}\) ?|[0-9]{2,5}[ .-])[0-9]{2,5}(?:[ .-][0-9]{2,5}){1,4}(?![0-9A-Za-z-])"),
    ("phone", r"(?<![0-9A-Za-z.,+/-])[0-9(][0-9()/. -]{5,19}+(?<=[0-9])(?![0-9A-Za-z])"),
)
#: Characters before a candidate that count as its context.
CONTEXT = 32
#: Generated rows the trees are fitted and calibrated on, and the precision a threshold must reach.
SAMPLE, PRECISION = 6_000, 0.98
CUES = {
    "phone": r"(?i)\b(?:tel|phone|call|mobile|cell|fax|dial|telefon|t[ée]l[ée]phone|tel[ée]fono|ruf)",
    "mail": r"(?i)\b(?:e-?mail|mail|contact|write|courriel|correo|reach)",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|karte|kreditkarte|carte|tarjeta)\b",
    "net": r"(?i)\b(?:ip|host|server|address|addr|login|client|from)\b",
    "other": r"(?i)\b(?:order|invoice|version|part|article|no|nr|ref|id|page|isbn|sku|date|since|until|total|price|serial|figure|table)\b[^a-z]*$",
}
FEATURES = ("digits", "chars", "groups", "longest", "first", "distinct", "parens", "dots", "dashes", "blanks", "letters", "colons", "twice", "luhn", "dateish", "kind", *(f"cue_{c}" for c in CUES))


#: Elements of an array that are summed up together, so that running sums of n elements take far fewer than n squared steps.
_PART = 128


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _parts(values: Column) -> Column:
    """An array (not empty) cut into arrays of _PART elements."""
    return _once(values, lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _PART).cast("int")), lambda k: F.slice(v, k * _PART + 1, F.lit(_PART))))


def _before(values: Column, zero: int, op: Callable[[Column, Column], Column]) -> Column:
    """For each of the longs in an array (not empty), what ``op`` makes of all before it."""
    total = lambda part, start: F.aggregate(part, start, op)
    nothing = F.lit(zero).cast("long")
    head = lambda part, n: F.slice(part, F.lit(1), n)

    def each(parts: Column) -> Column:
        return _once(F.transform(parts, lambda p: total(p, nothing)), lambda sums: F.flatten(F.transform(parts, lambda p, k: _once(total(head(sums, k), nothing), lambda start: F.transform(p, lambda _, i: total(head(p, i), start))))))

    return _once(_parts(values), each)


_MATCH = "struct<start:bigint,word:string,before:string>"


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<start, word, before>> of all matches, leftmost first; offsets in code points. ``before``: up to
    CONTEXT characters of the text between two matches and of the match before that."""
    cut = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("words"))

    def spans(c: Column) -> Column:
        gaps = F.transform(c["gaps"], lambda g: F.length(g).cast("long"))
        both = F.zip_with(gaps, F.transform(c["words"], lambda w: F.length(w).cast("long")), lambda g, w: g + F.coalesce(w, F.lit(0).cast("long")))
        starts = F.zip_with(_before(both, 0, lambda x, y: x + y), gaps, lambda at, g: at + g)
        tail = lambda s: F.right(s, F.lit(CONTEXT))
        before = F.zip_with(F.concat(F.array(F.lit("")), c["words"]), c["gaps"], lambda w, g: tail(F.concat(tail(w), tail(g))))
        found = F.zip_with(starts, c["words"], lambda at, w: F.struct(at.alias("start"), w.alias("word")))
        found = F.zip_with(found, before, lambda x, b: F.struct(x["start"].alias("start"), x["word"].alias("word"), b.alias("before")))
        return F.filter(found, lambda x: x["word"].isNotNull())

    return F.when(text.rlike(pattern), _once(cut, spans)).otherwise(F.lit(None).cast(f"array<{_MATCH}>"))


def _digits(word: Column) -> Column:
    return F.regexp_replace(word, "[^0-9]", "")


def _luhn(word: Column) -> Column:
    """Whether the digits of a word fulfil Luhn's rule: from the right every second one counts double."""
    d = F.reverse(_digits(word))
    value = lambda i: F.substring(d, i + 1, 1).cast("int") * (1 + i % 2)
    terms = F.transform(F.sequence(F.lit(0), F.length(d) - 1), lambda i: F.when(value(i) > 9, value(i) - 9).otherwise(value(i)))
    return F.aggregate(terms, F.lit(0), lambda a, b: a + b) % 10 == 0


def base_spans(text: Column) -> Column:
    """array<struct<start, kind number, end>> of the base rules, in order of start and kind."""
    count = lambda w: F.length(_digits(w))
    small = r"^0*+(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
    checks = {
        "email": (EMAIL, text.contains("@"), lambda w: F.lit(True)),
        "ip": (IP, F.lit(True), lambda w: F.forall(F.split(w, r"\."), lambda p: p.rlike(small))),
        "card": (CARD, F.lit(True), lambda w: count(w).between(12, 19) & _luhn(w)),
        "phone": (PHONE, text.contains("+"), lambda w: count(w).between(9, 15)),
    }
    parts = []
    for k, kind in enumerate(KINDS):
        pattern, maybe, good = checks[kind]
        found = F.filter(F.when(maybe, _matches(text, pattern)), lambda m: good(m["word"]))
        parts.append(F.coalesce(F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), (m["start"] + F.length(m["word"])).alias("end"))), F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")))
    return F.array_sort(F.concat(*parts))


def candidates(text: Column) -> Column:
    """array<struct<start, word, kind number, before>> of what the generators propose."""
    none = F.array().cast("array<struct<start:bigint,word:string,kind:int,before:string>>")
    parts = []
    for kind, pattern in GENERATORS:
        found = F.transform(_matches(text, pattern), lambda m: F.struct(m["start"].alias("start"), m["word"].alias("word"), F.lit(KINDS.index(kind)).alias("kind"), m["before"].alias("before")))  # noqa: B023
        parts.append(F.coalesce(found, none))
    return F.concat(*parts)


def describe(word: Column, kind: Column, before: Column) -> dict[str, Column]:
    """The numbers that the trees look at: FEATURES."""
    digits, groups = _digits(word), F.regexp_extract_all(word, F.lit("[0-9]+"), F.lit(0))
    sizes = F.transform(groups, F.length)
    tally = lambda pattern: F.length(word) - F.length(F.regexp_replace(word, pattern, ""))
    out = {
        "digits": F.length(digits), "chars": F.length(word), "groups": F.size(groups), "longest": F.coalesce(F.array_max(sizes), F.lit(0)), "first": F.coalesce(F.get(sizes, F.lit(0)), F.lit(0)),
        "distinct": F.size(F.array_distinct(F.split(digits, ""))), "parens": tally("[()\\[\\]{}]"), "dots": tally("[.]"), "dashes": tally("-"), "blanks": tally(" "), "letters": tally("[A-Za-z]"), "colons": tally(":"), "twice": word.contains("::").cast("int"), "luhn": F.when(F.length(digits) > 0, _luhn(word)).otherwise(False).cast("int"),
        "dateish": word.rlike(r"^(?:(?:19|20)[0-9]{2}[ .-][01]?[0-9][ .-][0-3]?[0-9]|[0-3]?[0-9][ .-][01]?[0-9][ .-](?:(?:19|20)[0-9]{2}|[0-9]{2}))(?:$|[^0-9])").cast("int"), "kind": kind,
    }
    out |= {f"cue_{c}": before.rlike(p).cast("int") for c, p in CUES.items()}
    return {k: out[k].cast("double") for k in FEATURES}


def generated_sample(spark: SparkSession, rows: int = SAMPLE) -> DataFrame:
    """Generated candidates with labels: (word, kind, before, label), the same at every call."""
    r = lambda salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1 << 30)) / (1 << 30)
    pick = lambda salt, *options: F.element_at(F.array(*(o if isinstance(o, Column) else F.lit(o) for o in options)), (F.floor(r(salt) * len(options)) + 1).cast("int"))
    num = lambda salt, n: F.lpad(F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(10**n)).cast("string"), n, "7")
    word = lambda salt: pick(salt, "anna", "b.meier", "info", "sales99", "j_doe", "office", "kim.lee", "root")
    sep = pick("s", "-", " ", ".")
    phones = pick("p", F.concat(F.lit("("), num(1, 3), F.lit(") "), num(2, 3), F.lit("-"), num(3, 4)), F.concat(num(1, 3), sep, num(2, 3), sep, num(3, 4)), F.concat(F.lit("0"), num(1, 3), sep, num(2, 3), sep, num(3, 2), sep, num(4, 2)), F.concat(F.lit("0"), num(1, 1), sep, num(2, 2), sep, num(3, 2), sep, num(4, 2), sep, num(5, 2)))
    numbers = pick("n", F.concat(pick("y", "19", "20"), num(1, 2), sep, num(2, 2), sep, num(3, 2)), F.concat(num(1, 2), sep, num(2, 2), sep, num(3, 4)), F.concat(num(1, 2), F.lit("."), num(2, 3), F.lit("."), num(3, 3)), F.concat(num(1, 3), F.lit("-"), num(2, 5), F.lit("-"), num(3, 2)), F.concat(num(1, 3), F.lit(" "), num(2, 3), F.lit(" "), num(3, 3)), F.concat(num(1, 5), F.lit("-"), num(2, 5), F.lit("-"), num(3, 5)))
    mails = F.concat(word("w"), pick("at", "(at)", " [at] ", " (at) "), pick("d", "example", "mail-host", "uni"), pick("dot", "(dot)", " [dot] ", ".", " (dot) "), pick("tld", "org", "com", "de"))
    nomails = F.concat(pick("m", "meet", "5", "x", "line"), F.lit(" (at) "), num(1, 2), F.lit("."), num(2, 2))
    hexa = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.lower(F.substring(F.hex(F.xxhash64("id", i)), 1, 4))), ":")
    nohex = F.concat_ws(":", *(num(k, 2) for k in range(8)))
    plain = F.concat(pick("pl", "0", "", "1", "4"), num(11, 4), pick("ps", "", "", "/", " "), num(12, 5))
    d15 = F.substring(F.concat(pick("cd", "4", "5", "37"), num(13, 12), num(14, 3)), 1, 15)
    last = lambda valid: F.element_at(F.filter(F.sequence(F.lit(0), F.lit(9)), lambda c: _luhn(F.concat(d15, c.cast("string"))) == F.lit(valid)), 1).cast("string")
    between = pick("k", ".", " - ", "_", "/", "  ")
    card = lambda valid: _once(F.concat(d15, last(valid)), lambda n: F.concat(*(x for k in range(4) for x in (*([between] if k else []), F.substring(n, 1 + 4 * k, 4)))))
    short_hex = F.concat(pick("h1", "fe80", "2001:db8", "fd12:3456", "2a00:1450:4001"), F.lit("::"), F.lower(F.substring(F.hex(F.xxhash64("id")), 1, 3)), pick("h2", "", ":1", ":20:a"))
    times = F.concat(pick("t1", "0", "1"), num(15, 1), F.lit(":"), pick("t2", "0", "3", "5"), num(16, 1), F.lit(":"), pick("t3", "1", "2", "4"), num(17, 1))
    told = {"card": ("card no ", "paid by Visa ", "credit card: ", "Kreditkarte ", "carte "), "phone": ("Tel. ", "call me: ", "phone ", "fax ", "Telefon: "), "mail": ("e-mail: ", "contact ", "write to "), "net": ("host ", "login from ", "address "), "number": ("order no ", "invoice ", "version ", "ref ", "since ", "total ", "the ", "page "), "none": ("", "and ", "of ", "the word ")}
    cases = [
        (phones, 3, pick("c", *told["phone"]), 1), (phones, 3, pick("c", *told["phone"], *told["mail"]), 1), (numbers, 3, pick("c", *told["number"]), 0), (numbers, 3, pick("c", *told["none"]), 0), (phones, 3, pick("c", *told["number"]), 0),
        (mails, 0, pick("c", *told["mail"], *told["none"], *told["number"]), 1), (nomails, 0, pick("c", *told["none"], *told["number"]), 0), (hexa, 1, pick("c", *told["net"], *told["none"]), 1), (nohex, 1, pick("c", *told["number"], *told["none"]), 0),
        (plain, 3, pick("c", *told["phone"]), 1), (plain, 3, pick("c", *told["number"], *told["none"]), 0), (plain, 3, pick("c", *told["number"], *told["none"]), 0), (short_hex, 1, pick("c", *told["net"], *told["none"]), 1), (times, 1, pick("c", *told["number"], *told["none"]), 0), (F.lit("::"), 1, pick("c", *told["none"], *told["net"]), 0),
        (card(True), 2, pick("c", *told["card"]), 1), (card(False), 2, pick("c", *told["number"], *told["none"], *told["card"]), 0), (card(False), 3, pick("c", *told["number"], *told["none"], *told["card"]), 0), (card(True), 3, pick("c", *told["card"]), 0),
    ]
    case = F.pmod("id", F.lit(len(cases)))
    rows_ = spark.range(rows).withColumn("e", F.coalesce(*(F.when(case == n, F.struct(w.alias("word"), F.lit(k).alias("kind"), b.alias("before"), F.lit(y).alias("label"))) for n, (w, k, b, y) in enumerate(cases))))
    return rows_.select("id", "e.*")


@dataclass(frozen=True)
class Model:
    """Trees as nested (feature, threshold, left, right) or leaf values, with weights, and thresholds by kind."""

    trees: tuple
    weights: tuple[float, ...]
    thresholds: dict[int, float]

    def margin(self, x: Column) -> Column:
        """``x``: array of the FEATURES."""

        def case(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            feature, threshold, left, right = node
            return F.when(x.getItem(feature) <= threshold, case(left)).otherwise(case(right))

        out = F.lit(0.0)
        for tree, w in zip(self.trees, self.weights):
            out = out + case(tree) * w
        return out

    def accepted(self, found: Column) -> Column:
        """Of candidates (start, word, kind, before) those that the trees take: array<struct<start, kind, end>>."""
        floor = lambda kind: F.coalesce(*(F.when(kind == k, t) for k, t in self.thresholds.items()), F.lit(1.1))
        seen = F.transform(found, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), (c["start"] + F.length(c["word"])).alias("end"), F.array(*describe(c["word"], c["kind"], c["before"]).values()).alias("x")))
        good = F.filter(seen, lambda c: 1 / (1 + F.exp(-2 * self.margin(c["x"]))) >= floor(c["kind"]))
        return F.transform(good, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))


def train(spark: SparkSession, rows: int = SAMPLE) -> Model:
    """Fit on three quarters of the generated sample; the rest sets the least threshold of each kind at which
    PRECISION is reached (a kind that never reaches it accepts nothing)."""
    data = generated_sample(spark, rows)
    data = data.select("id", "kind", F.col("label").cast("double"), array_to_vector(F.array(*describe(F.col("word"), F.col("kind"), F.col("before")).values())).alias("features")).repartition(2, "id").cache()
    model = GBTClassifier(labelCol="label", maxIter=12, maxDepth=4, stepSize=0.3, seed=7, maxBins=32).fit(data.filter("id % 4 <> 0"))
    held = model.transform(data.filter("id % 4 = 0")).select("kind", "label", vector_to_array("probability")[1].alias("p")).collect()
    data.unpersist()

    def node(n) -> tuple | float:
        if n.subtreeDepth() == 0:
            return float(n.prediction())
        split = n.split()
        return split.featureIndex(), float(split.threshold()), node(n.leftChild()), node(n.rightChild())

    thresholds = {}
    for kind in sorted({r.kind for r in held}):
        rows_ = [(r.p, r.label) for r in held if r.kind == kind]
        for t in sorted({p for p, y in rows_ if y}):
            over = [y for p, y in rows_ if p >= t]
            if sum(over) >= PRECISION * len(over):
                thresholds[kind] = max(0.5, t) - 1e-9  # sums may differ in the last bits
                break
    return Model(tuple(node(t._call_java("rootNode")) for t in model.trees), tuple(model.treeWeights), thresholds)


def _merge(base: Column, good: Column) -> Column:
    """Base spans, and candidates that overlap none of them and don't lie within one that begins before."""
    none, far = 0, 1 << 62
    most, least = lambda x, y: F.greatest(x, y), lambda x, y: F.least(x, y)
    mark = lambda spans, n: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("base"), s["kind"].alias("kind"), s["end"].alias("end")))

    def sift(every: Column) -> Column:
        pick = lambda s, n, value, other: F.when(s["base"] == n, value).otherwise(F.lit(other).cast("long"))
        based = _before(F.transform(every, lambda s: pick(s, 0, s["end"], none)), none, most)
        taken = _before(F.transform(every, lambda s: pick(s, 1, s["end"], none)), none, most)
        later = F.reverse(_before(F.transform(F.reverse(every), lambda s: pick(s, 0, s["start"], far)), far, least))
        seen = F.zip_with(F.zip_with(every, based, lambda s, x: F.struct(s.alias("s"), x.alias("based"))), F.zip_with(taken, later, lambda x, y: F.struct(x.alias("taken"), y.alias("later"))), lambda a, b: F.struct(a["s"].alias("s"), a["based"].alias("based"), b["taken"].alias("taken"), b["later"].alias("later")))
        stay = F.filter(seen, lambda x: (x["s"]["base"] == 0) | (x["based"] <= x["s"]["start"]) & (x["later"] >= x["s"]["end"]) & (x["taken"] < x["s"]["end"]))
        return F.transform(stay, lambda x: F.struct(x["s"]["start"].alias("start"), x["s"]["kind"].alias("kind"), x["s"]["end"].alias("end")))

    return F.when(F.size(good) > 0, F.array_sort(_once(F.array_sort(F.concat(mark(base, 0), mark(good, 1))), sift))).otherwise(base)


def find(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` (it has text) with base and spans: array<struct<start, kind, end>> each.

    base follows the fixed rules; spans adds accepted candidates that overlap no base span and don't lie within an
    accepted candidate that begins before them. Offsets count code points, ends are exclusive. A null or empty text has none; columns
    of these names that ``docs`` has already give way. Work is a row at a time and in proportion to the text and its
    matches: repeated rows, ties, nulls in other columns and empty tables need no rule.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.drop("base", "spans").withColumn("base", base_spans(text))
    maybe = F.lit(False)
    for _, pattern in GENERATORS:
        maybe = maybe | text.rlike(pattern)
    return docs.withColumn("spans", F.when(maybe, _once(model.accepted(candidates(text)), lambda good: _merge(F.col("base"), good))).otherwise(F.col("base")))


def render(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one.

    A text is cut into stretches of _PART spans first, so that the cost stays in proportion to it.
    """
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    cut = lambda s, a, b: F.substring(s, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
    # apart: where the text before a span starts, where it ends, and the span's kind; at last the text behind all spans
    tail = F.struct(F.array_max(F.transform(spans, lambda x: x["end"])).alias("a"), F.length(text).cast("long").alias("b"), F.lit(-1).alias("kind"))
    gaps_ = F.zip_with(_before(F.transform(spans, lambda x: x["end"]), 0, lambda x, y: F.greatest(x, y)), spans, lambda at, x: F.struct(at.alias("a"), x["start"].alias("b"), x["kind"].alias("kind")))
    apart = F.concat(F.filter(gaps_, lambda g: g["a"] <= g["b"]), F.array(tail))

    def stretch(gaps: Column) -> Column:
        first = F.element_at(gaps, 1)["a"]
        own = cut(text, first, F.element_at(gaps, -1)["b"])
        return _once(own, lambda t: F.array_join(F.transform(gaps, lambda g: F.concat(cut(t, g["a"] - first, g["b"] - first), F.when(g["kind"] >= 0, F.concat(F.lit("<"), name(F.greatest(g["kind"], F.lit(0))), F.lit(">"))).otherwise(""))), ""))

    return F.when(F.size(spans) > 0, F.array_join(F.transform(_parts(apart), stretch), "")).otherwise(text)
