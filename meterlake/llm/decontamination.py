"""Benchmark decontamination over a positional inverted index of the training documents.

The index stores a posting (term, document, position) for every occurrence of a benchmark word in
the documents, once, and its counts say which terms of a window are rarest. Windows of consecutive
benchmark words are looked up from there: the postings of a window's rarest term are intersected
with those of the second rarest, first within a distance, which gives the proximity matches, then
at their adjusted offset; what is left is intersected with the lists of all other terms at theirs,
which gives the exact phrases.

The index is built where the documents are read, and rows of it never hold more than one posting.
Benchmark words, windows and the few positions left to look up are broadcast only while they are
fewer than ``MAX_BROADCAST``; beyond that the same joins shuffle.

Defined results: null texts have no words and match nothing; null items have no windows; repeated
document rows are judged alike and each is returned; equal doc_ids with different texts are judged
apart; repeated items count by their item_id; empty tables give no rows or no hits; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.llm.common import chosen_rows, stored, whole

WINDOW = 10
MAX_BROADCAST = 300_000
#: Words that the two rarest terms of a window may stand apart in a proximity match.
NEAR = 20
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """A-Z in lower case and nothing else; plain ASCII takes the fast way."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lowered(text), BREAK), "")


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast ``df`` only if its counted rows are few."""
    return F.broadcast(df) if rows <= MAX_BROADCAST else df


def windows_of(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The distinct windows of each item: item_id, phrase (array of words)."""
    split = items.select("item_id", words_of(whole()).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    return split.select("item_id", "w", F.explode(starts).alias("s")).select("item_id", F.slice("w", F.col("s"), window).alias("phrase")).distinct()


def _keyed(docs: DataFrame) -> DataFrame:
    """Documents with their words; a hash of the text tells rows of equal doc_id apart."""
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), words_of(whole()).alias("words"))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The stored index: doc_id, text_key, term and pos of every occurrence of the ``terms``."""
    rows = _keyed(docs).select("doc_id", "text_key", F.posexplode("words").alias("pos", "term"))
    return stored(rows.join(bounded(terms, terms.count()), "term").select("term", "doc_id", "text_key", "pos"), "postings")


def anchored(windows: DataFrame, index: DataFrame) -> DataFrame:
    """Each window with its rarest term and its second rarest, and their offsets."""
    counts = index.groupBy("term").count()
    each = windows.select("item_id", "phrase", F.posexplode("phrase").alias("at", "term"))
    known = each.join(counts, "term", "left").withColumn("n", F.coalesce("count", F.lit(0)))
    ranked = known.groupBy("item_id", "phrase").agg(F.array_sort(F.collect_list(F.struct("n", "at", "term"))).alias("r"))
    first, second = F.col("r")[0], F.coalesce(F.get("r", F.lit(1)), F.col("r")[0])
    return ranked.where(first["n"] > 0).select(
        "item_id", "phrase", first["term"].alias("term"), first["at"].alias("at"),
        second["term"].alias("term2"), second["at"].alias("at2"),
    )


def same_text(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_key"] == b["text_key"])


def near(index: DataFrame, pairs: DataFrame, within: int = NEAR) -> DataFrame:
    """Proximity matches: the columns of ``pairs`` with doc_id, text_key and the positions pos of ``term`` and pos2 of ``term2``.

    Positions are met in stretches of ``within`` words, so a frequent term costs no more in a long text.
    ``alone`` pairs have one term only and match wherever it is.
    """
    n = pairs.count()
    first = index.join(bounded(pairs, n), "term")
    stretch = F.floor(F.col("pos") / within)
    around = first.withColumn("stretch", F.explode(F.array(stretch - 1, stretch, stretch + 1))).where("not alone")
    second = index.join(bounded(pairs.where("not alone").select(F.col("term2").alias("term")).distinct(), n), "term", "left_semi")
    second = second.select(F.col("term").alias("_term"), "doc_id", "text_key", F.col("pos").alias("pos2"), stretch.alias("_stretch"))
    met = around.join(second, (F.col("term2") == F.col("_term")) & (F.col("stretch") == F.col("_stretch")) & same_text(around, second))
    met = met.where((F.abs(F.col("pos") - F.col("pos2")) <= within) & (F.col("pos") != F.col("pos2")))
    columns = [*pairs.columns, "pos", "pos2"]
    found = met.select(around["doc_id"], around["text_key"], *columns)
    return found.unionByName(first.where("alone").withColumn("pos2", F.col("pos")).select("doc_id", "text_key", *columns)).distinct()


PAIR = ["term", "term2", "alone"]


def phrase_hits(index: DataFrame, matches: DataFrame, anchors: DataFrame) -> DataFrame:
    """Exact occurrences among proximity matches: doc_id, text_key, item_id, start, n."""
    start = F.col("pos") - F.col("at")
    placed = matches.join(bounded(anchors, anchors.count()), PAIR).where((start >= 0) & (F.col("pos2") == start + F.col("at2")))
    placed = stored(placed.select("doc_id", "text_key", "item_id", "phrase", start.alias("start"), "at", "at2"), "placed")
    words = placed.select("*", F.posexplode("phrase").alias("k", "word")).where("k <> at and k <> at2")
    wanted = words.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "item_id", "phrase", "start", "k", F.col("word").alias("_term"), (F.col("start") + F.col("k")).alias("_pos"))
    texts = placed.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    index = index.join(bounded(texts, texts.count()), index["doc_id"].eqNullSafe(F.col("_id")) & (index["text_key"] == F.col("_key")), "left_semi")
    here = (index["term"] == F.col("_term")) & (index["pos"] == F.col("_pos")) & index["doc_id"].eqNullSafe(F.col("_id")) & (index["text_key"] == F.col("_key"))
    met = index.join(bounded(wanted, wanted.count()), here).groupBy("doc_id", "text_key", "item_id", "phrase", "start").agg(F.count_distinct("k").alias("met"))
    n = F.size("phrase")
    whole_ones = placed.where(n <= 2).select("doc_id", "text_key", "item_id", "start", n.alias("n"))
    return whole_ones.unionByName(met.where(F.col("met") == n - 2).select("doc_id", "text_key", "item_id", "start", n.alias("n")))


def found(docs: DataFrame, items: DataFrame, window: int = WINDOW, within: int = NEAR) -> tuple[DataFrame, DataFrame]:
    """Proximity matches (doc_id, text_key, item_id) and exact occurrences of the items' windows in the documents."""
    windows = stored(windows_of(items, window), "windows")
    index = postings(docs, windows.select(F.explode("phrase").alias("term")).distinct())
    anchors = stored(anchored(windows, index).withColumn("alone", F.size("phrase") == 1), "anchors")
    matches = stored(near(index, anchors.select(*PAIR).distinct(), max(within, window - 1)), "matches")
    close = matches.where(F.abs(F.col("pos") - F.col("pos2")) <= within).select("doc_id", "text_key", *PAIR).distinct()
    items_of = anchors.select("item_id", *PAIR).distinct()
    return close.join(bounded(items_of, items_of.count()), PAIR).select("doc_id", "text_key", "item_id"), phrase_hits(index, matches, anchors)


def hits_by_document(exact: DataFrame) -> DataFrame:
    """For each document with a hit: doc_id, text_key, spans (start, n) in order, item_ids."""
    return exact.groupBy("doc_id", "text_key").agg(
        F.array_sort(F.collect_set(F.struct("start", "n"))).alias("spans"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
    )


def covered(spans: Column) -> Column:
    """How many words lie in at least one of the spans, which are ordered by start."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda acc, s: F.struct(
        F.greatest(acc["end"], s["start"] + s["n"]).alias("end"),
        (acc["n"] + F.greatest(F.lit(0), s["start"] + s["n"] - F.greatest(acc["end"], s["start"]))).alias("n"),
    )
    return F.aggregate(spans, zero, step, lambda acc: acc["n"])


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, within: int = NEAR) -> DataFrame:
    """One row per document with its hit words and the items found in it.

    ``n_near`` counts the items of which the two rarest terms of a window stand at most ``within`` words apart.
    """
    close, exact = found(docs, items, window, within)
    near_items = close.groupBy("doc_id", "text_key").agg(F.count_distinct("item_id").alias("n_near"))
    hits = hits_by_document(exact)
    both = near_items.join(hits, same_text(near_items, hits), "left").select(near_items["doc_id"].alias("_id"), near_items["text_key"].alias("_key"), "n_near", "spans", "items")
    all_docs = _keyed(docs).select("doc_id", "text_key", F.size("words").cast("long").alias("n_words"))
    joined = all_docs.join(both, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    n_hit = F.coalesce(covered(F.col("spans")), F.lit(0)).cast("long")
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items_).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without a hit, with their own columns."""
    hits = found(docs, items, window)[1].select(F.struct("doc_id", "text_key")).distinct()
    key = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"))
    return chosen_rows(docs, key, hits, "left_anti")
