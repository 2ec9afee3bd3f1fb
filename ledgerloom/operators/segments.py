"""Pages to documents: the type of a page, where a new document begins, and the type a document's pages vote for.

Pages are rows source_id, page_no, page_id, blank, has_title, has_footer, continuation_like, role_hint,
page_doc_type, hard_type (sure signs of a type, or null), scores (map of type to count).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.ordered import roles

#: Types in the order that decides ties.
TYPES = ("invoice", "waybill", "payment_order", "account_prot")
_OPENS, _CLOSES = ("single_candidate", "first_candidate"), ("single_candidate", "last_candidate")


def page_type(scores: dict[str, Column], payment_title: Column, waybill_title: Column, protocol_title: Column) -> Column:
    """A title decides; else the highest score, ties by TYPES; unknown if none is positive."""
    best = F.greatest(*(scores[t] for t in TYPES))
    out = F.when(payment_title, "payment_order").when(waybill_title, "waybill").when(protocol_title, "account_prot").when(best <= 0, "unknown")
    for t in TYPES:
        out = out.when(scores[t] == best, t)
    return out


def blank_page(text: Column, has_title: Column, has_footer: Column) -> Column:
    """Few signs, or few letters and digits in few words, and neither title nor footer."""
    t = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(t, F.lit("([A-Za-zА-Яа-яЁё0-9]{2,})"), F.lit(1))
    compact, useful, words = F.length(F.regexp_replace(t, r"(?U)\s", "")), F.length(F.array_join(words, "")), F.size(words)
    return ((compact < 25) | ((useful < 18) & (words <= 3))) & ~has_title & ~has_footer


class _Vote:
    """The type that the pages of a running document vote for; a page costs the same however long it grows."""

    def __init__(self) -> None:
        self.first: set[str] = set()
        self.hard: Counter[str] = Counter()
        self.scores: Counter[str] = Counter()

    def add(self, hard: str | None, role: str | None, scores: dict[str, int]) -> None:
        if hard:
            self.hard[hard] += 1
            if role in _OPENS:
                self.first.add(hard)
        self.scores.update(scores)

    def type(self) -> str | None:
        if self.first:
            return next(iter(self.first)) if len(self.first) == 1 else None
        if self.hard:
            top = self.hard.most_common(2)
            return top[0][0] if len(top) == 1 or top[1][1] < top[0][1] else None
        best = max(TYPES, key=lambda t: self.scores[t])
        return best if self.scores[best] > 0 else None


def segments(pages: DataFrame) -> DataFrame:
    """source_id, page_no, page_id, segment_no for all pages that aren't blank.

    A document begins at a gap in page numbers, at a titled payment order, and at a titled page after a closed
    one if the type changes or the page before ended in a footer. The vote of the running document takes part
    in that, so pages are walked in order, from batch to batch, and only the running document's tallies are held.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, before, vote, number = object(), None, _Vote(), 0
        for batch in batches:
            out = []
            for p in batch.itertuples(index=False):
                if before is None or p.source_id != source:
                    source, vote, number, new = p.source_id, _Vote(), 1, False
                else:
                    kind = p.page_doc_type
                    strong = bool(p.has_title) and not p.continuation_like
                    new = p.page_no != before.page_no + 1 or (kind == "payment_order" and strong)
                    if not new and strong and (before.has_footer or before.role_hint in _CLOSES):
                        so_far = vote.type()
                        new = bool(before.has_footer) or bool(so_far and kind and kind not in ("unknown", so_far))
                if new:
                    vote, number = _Vote(), number + 1
                vote.add(p.hard_type, p.role_hint, {t: int(p.scores.get(t) or 0) for t in TYPES} if p.scores else {})
                before = p
                out.append((p.source_id, p.page_no, p.page_id, number))
            yield pd.DataFrame(out, columns=["source_id", "page_no", "page_id", "segment_no"])

    used = pages.filter(~F.coalesce("blank", F.lit(False))).select("source_id", "page_no", "page_id", "has_title", "has_footer", "continuation_like", "role_hint", "page_doc_type", "hard_type", "scores")
    return used.repartition("source_id").sortWithinPartitions("source_id", "page_no", "page_id").mapInPandas(run, "source_id string, page_no int, page_id string, segment_no int")


def with_roles(found: DataFrame) -> DataFrame:
    """Adds page_role and segment_id (doc_01, doc_02, ...)."""
    return roles(found, ["source_id", "segment_no"], ["page_no", "page_id"]).withColumn("segment_id", F.format_string("doc_%02d", "segment_no"))


def segment_types(found: DataFrame, pages: DataFrame) -> DataFrame:
    """source_id, segment_no, pages, doc_type: the vote as an aggregate; 'unknown' where it is undecided."""
    both = found.select("source_id", "page_id", "segment_no").join(pages, ["source_id", "page_id"])
    hard = F.col("hard_type")
    first = F.collect_set(F.when(F.col("role_hint").isin(*_OPENS), hard))
    counts = [F.struct(F.count_if(hard == t).alias("n"), F.lit(-k).alias("k"), F.lit(t).alias("t")) for k, t in enumerate(TYPES)]
    sums = [F.struct(F.coalesce(F.sum(F.coalesce(F.try_element_at("scores", F.lit(t)).cast("long"), F.lit(0))), F.lit(0)).alias("n"), F.lit(-k).alias("k"), F.lit(t).alias("t")) for k, t in enumerate(TYPES)]
    votes = both.groupBy("source_id", "segment_no").agg(F.count("*").alias("pages"), first.alias("first"), F.array(*counts).alias("hard"), F.array(*sums).alias("sums"))
    best, top = F.array_max("hard"), F.array_max("sums")
    clear = F.size(F.filter("hard", lambda h: h.n == best.n)) == 1
    kind = F.when(F.size("first") == 1, F.element_at("first", 1)).when(F.size("first") > 1, None).when((best.n > 0) & clear, best.t).when(best.n > 0, None).when(top.n > 0, top.t)
    return votes.select("source_id", "segment_no", "pages", F.coalesce(kind, F.lit("unknown")).alias("doc_type"))


def progress(flags: list[Column]) -> Column:
    """Per cent of the stages done, cut to a whole number."""
    return F.floor(sum((f.cast("int") for f in flags), F.lit(0)) / len(flags) * 100)


def renumber(items: DataFrame, key: str, order: list[str]) -> DataFrame:
    """line_number from 1 in each document."""
    return items.withColumn("line_number", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
