"""What an overview of a run shows: lists of documents and events, rates, export sums, manifests, shares without review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col
#: Documents and events that a list shows at most; this is what the feature shows.
DOCUMENTS, EVENTS = 250, 200


def _share(n: Column, of: Column, none: float, places: int) -> Column:
    """n per hundred of ``of``, to so many places; ``none`` where there is nothing to share."""
    scale = 10.0**places
    return F.when(of > 0, F.floor(n * 100.0 * scale / of + 0.5) / scale).otherwise(none)


def recent_documents(documents: DataFrame, keep: Column, updated: str, key: str, most: int = DOCUMENTS) -> DataFrame:
    """The ``most`` documents updated last of those to keep."""
    return documents.filter(keep).orderBy(F.desc(updated), key).limit(most)


def matching(documents: DataFrame, words: str, columns: list[str], *also: Column) -> DataFrame:
    """Documents of whose columns one holds ``words``, whatever the case, and that fulfil all else that is asked for."""
    out = documents.filter(F.lower(F.concat_ws(" ", *columns)).contains(words.lower()))
    for condition in also:
        out = out.filter(condition)
    return out


def rates(documents: DataFrame, completed: Column, processing: Column, failed: Column) -> DataFrame:
    """total, completed, processing, failed, success_rate (of all) and finished_rate (of those that ended; 100 while none has)."""
    s = documents.agg(F.count("*").alias("total"), *(F.count_if(x).alias(n) for n, x in (("completed", completed), ("processing", processing), ("failed", failed))))
    return s.select("*", _share(c("completed"), c("total"), 0.0, 1).alias("success_rate"), _share(c("completed"), c("completed") + c("failed"), 100.0, 1).alias("finished_rate"))


def export_sums(documents: DataFrame, ready: Column, amount: Column) -> DataFrame:
    """documents, ready, attention and the amount of those that are ready."""
    return documents.agg(F.count("*").alias("documents"), F.count_if(ready).alias("ready"), F.count_if(~ready).alias("attention"), (F.floor(F.sum(F.when(ready, amount)) * 100 + 0.5) / 100).alias("ready_amount"))


def fullest_page(pages: DataFrame, key: str, page: str, fields: list[Column]) -> DataFrame:
    """key, fields, page_no: the page of each document with most of ``fields`` present, the first of equal ones."""
    n = sum((F.coalesce(f, F.lit(False)).cast("int") for f in fields), F.lit(0))
    best = F.max(F.struct(n.alias("fields"), (-c(page)).alias("before")))
    return pages.groupBy(key).agg(best.alias("b")).select(key, "b.fields", (-c("b.before")).alias("page_no"))


def review_free(fields: DataFrame, key: str, in_review: Column) -> DataFrame:
    """documents, clean_documents and the shares of documents and of fields that need no review."""
    d = fields.groupBy(key).agg(F.count("*").alias("fields"), F.count_if(in_review).alias("review"))
    clean, none = F.count_if(c("review") == 0), F.lit(0.0)
    pct = lambda n, of: F.coalesce(_share(n, of, 0.0, 2), none)
    return d.agg(F.count("*").alias("documents"), clean.alias("clean_documents"), pct(clean, F.count("*")).alias("clean_documents_pct"), pct(F.sum(c("fields") - c("review")), F.sum("fields")).alias("clean_fields_pct"))


def review_marks(marks: dict[str, Column]) -> dict[str, Column]:
    """How many linked fields bear the mark of review, and whether any does."""
    each = F.array(*(F.coalesce(m, F.lit(False)) for m in marks.values()))
    return {"review_fields": F.size(F.filter(each, lambda x: x)), "review": F.exists(each, lambda x: x)}


def recent_events(events: DataFrame, time: str, key: str, most: int = EVENTS) -> DataFrame:
    """The ``most`` newest events with ``place``, the oldest of them first."""
    newest = events.orderBy(F.desc(time), F.desc(key)).limit(most)
    return newest.withColumn("place", F.row_number().over(Window.orderBy(time, key)))


def events_of_cards(cards: DataFrame, events: DataFrame, key: str, failed: Column) -> DataFrame:
    """key, event: one event made from the card of each document that has none."""
    return cards.join(events.select(key).distinct(), key, "left_anti").select(key, F.when(failed, "failed").otherwise("completed").alias("event"))


def manifest(pages: DataFrame, key: str, page: str, segment: str) -> DataFrame:
    """key, pages, segments, outputs, first_page, last_page of each document, as a run's summary lists them."""
    return pages.groupBy(key).agg(F.count_distinct(page).alias("pages"), F.count_distinct(segment).alias("segments"), F.array_join(F.array_sort(F.collect_set(segment)), ",").alias("outputs"), F.min(page).alias("first_page"), F.max(page).alias("last_page"))


def supported_mode(rows: DataFrame, key: str, value: str, least: int = 2) -> DataFrame:
    """key, value, votes: the most frequent value of each key that ``least`` rows bear or more; the smaller one of equals."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("votes")).filter(c("votes") >= least)
    best = counts.groupBy(key).agg(F.min_by(F.struct(value, "votes"), F.struct(-c("votes"), c(value))).alias("b"))
    return best.select(key, f"b.{value}", "b.votes")


def first_lines(lines: DataFrame, key: str, order: str, line: str) -> DataFrame:
    """key, key_text, first: the different lines of each document, whatever the case and outer blanks, and where each stands first."""
    return lines.withColumn("key_text", F.lower(F.trim(line))).filter("key_text <> ''").groupBy(key, "key_text").agg(F.min(order).alias("first"))


def stages_left(done: Column, wanted: list[str], needed: list[str]) -> dict[str, Column]:
    """How many of the wanted stages are not done, and whether all that are needed are."""
    left = lambda names: F.size(F.array_except(F.array(*map(F.lit, names)), done))
    return {"open_stages": left(wanted), "ready": left(needed) == 0}


def last_match(text: Column, pattern: str) -> tuple[Column, Column]:
    """The last match of a pattern's first group, null without one, and how many there are."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1))
    return F.nullif(F.try_element_at(found, F.lit(-1)), F.lit("")), F.size(found)


def file_stem(path: Column) -> Column:
    """A file's name without folders and suffix, in small letters, with one blank for each run of other signs than letters and digits."""
    name = F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"\.[^.]*$", "")
    return F.trim(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", " "))


def with_originals(archived: DataFrame, originals: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Archived pages with the ``original`` of the same stem (the first by name of several), and those that have none."""
    stems = originals.select(file_stem(c(path)).alias("_stem"), c(path).alias("original")).groupBy("_stem").agg(F.min("original").alias("original"))
    named = archived.withColumn("_stem", file_stem(c(path)))
    return named.join(stems, "_stem").drop("_stem"), named.join(stems, "_stem", "left_anti").drop("_stem")
