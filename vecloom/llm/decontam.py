"""Benchmark decontamination with a distributed positional inverted index.

Every window of the test items is looked up through its rarest term: the index stores the
training postings (document, position, surrounding words) of those lead terms only, and the
other terms of a window are intersected at their offsets from the lead. A window whose words
all stand in place is a *phrase* match; one whose words all stand nearby, in any order, is a
*near* match. Only built-in DataFrame functions are used.

Edge cases: null and empty texts have no words; an item without words has no window; an item
shorter than the window is one window; items without an id are left out; each row is a document
of its own, also if it shares its id or has none; repeated rows have equal results; a very long
text's postings are rows of their own, each with the few words around it; tables without rows
give none, and without items nothing is hit; other columns of either table are ignored. Nothing
is capped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm.common import mark_of, of_rows, text_or_empty, written

#: What separates words: ASCII other than letters and digits.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A table is broadcast if its rows and strings take at most so many bytes; else Spark joins by shuffle.
BROADCAST_BYTES = 64 << 20


def words_of(text: Column) -> Column:
    """Words as written; ascii_lower gives the compared form."""
    return F.array_remove(F.split(text, SEPARATORS), "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def if_small(df: DataFrame, *strings: str) -> DataFrame:
    """df, marked for broadcast if it has been measured to be small."""
    size = df.agg(F.coalesce(F.sum(sum((F.length(c) * 2 + 80 for c in strings), F.lit(80))), F.lit(0))).head()[0]
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def item_windows(items: DataFrame, width: int = 8, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, phrase (the window's words joined by spaces), n (its words); each once."""
    words = items.select(F.col(id_col).alias("item_id"), words_of(ascii_lower(text_or_empty(text_col))).alias("words"))
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - width + 1, F.lit(1)))).alias("at")
    cut = words.where((F.size("words") > 0) & F.col("item_id").isNotNull()).select("item_id", "words", starts)
    window = F.slice("words", F.col("at"), F.lit(width))
    return cut.select("item_id", F.concat_ws(" ", window).alias("phrase"), F.size(window).alias("n")).distinct()


def lead_terms(spark: SparkSession, docs: DataFrame, windows: DataFrame, text_col: str = "text") -> DataFrame:
    """phrase, n, term, offset: each window's rarest term in the corpus; windows with a term that never occurs are left out."""
    phrases = windows.select("phrase", "n").distinct()
    placed = phrases.select("phrase", "n", F.posexplode(F.split("phrase", " ")).alias("offset", "word")).withColumn("term", F.lower("word"))
    terms = written(placed.select("term").distinct(), spark, "decontam-terms")
    corpus = docs.select(F.explode(words_of(text_or_empty(text_col))).alias("word")).select(F.lower("word").alias("term"))
    counts = written(corpus.join(if_small(terms, "term"), "term").groupBy("term").agg(F.count("*").alias("df")), spark, "decontam-counts")
    known = placed.join(counts, "term", "left").groupBy("phrase", "n").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term", "offset")).alias("lead"))
    return known.where("lead.df > 0").select("phrase", "n", "lead.term", "lead.offset")


#: A row of the documents: its id, if any, and 64 bits of its text.
ROW = ["doc_id", "mark"]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), mark_of(F.col(text_col)).alias("mark"), words_of(text_or_empty(text_col)).alias("words"))


def postings(spark: SparkSession, docs: DataFrame, leads: DataFrame, width: int = 8, slop: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index: term, doc_id, mark, pos, and the words around with the first one's position."""
    terms = written(leads.select("term").distinct(), spark, "decontam-lead-terms")
    reach = width - 1 + slop
    rows, small = _rows(docs, id_col, text_col), if_small(terms, "term")
    first = F.greatest(F.col("pos") - reach, F.lit(0))
    around = ascii_lower(F.concat_ws(" ", F.slice("words", first + 1, F.lit(2 * reach + 1))))
    if small is terms:  # too many to broadcast: only places are shuffled to the terms, and a text goes once to its places
        each = rows.select(*ROW, F.posexplode("words").alias("pos", "word")).select(*ROW, "pos", F.lower("word").alias("term"))
        spots = each.join(terms, "term").groupBy(*ROW).agg(F.array_distinct(F.collect_list(F.struct("pos", "term"))).alias("spots"))
        at = F.inline("spots").alias("pos", "term")
        found = of_rows(rows, spots).select(*ROW, "words", at)
    else:
        found = rows.select(*ROW, "words", F.posexplode("words").alias("pos", "word")).withColumn("term", F.lower("word")).join(small, "term")
    return written(found.select("term", *ROW, "pos", first.alias("first"), around.alias("around")), spark, "decontam-postings")


def matches(spark: SparkSession, docs: DataFrame, items: DataFrame, width: int = 8, slop: int = 2, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, mark, phrase, start, n, kind: every phrase match, and near matches of windows at other places. start counts words from 0."""
    windows = item_windows(items, width, item_id, item_text)
    leads = written(lead_terms(spark, docs, windows, text_col), spark, "decontam-leads")
    index = postings(spark, docs, leads, width, slop, id_col, text_col)
    joined = index.join(if_small(leads, "phrase", "term"), "term")
    around, wanted = F.split("around", " "), F.split("phrase", " ")
    at = F.col("pos") - F.col("first") - F.col("offset")
    exact = (at >= 0) & (F.concat_ws(" ", F.slice(around, F.greatest(at, F.lit(0)) + 1, F.col("n"))) == F.col("phrase"))
    low = F.greatest(at - slop, F.lit(0))
    near = F.size(F.array_except(wanted, F.slice(around, low + 1, F.greatest(at + F.col("n") + slop - low, F.lit(0))))) == 0
    kind = F.when(exact, "phrase").when(near, "near")
    return joined.select(*ROW, "phrase", (F.col("pos") - F.col("offset")).alias("start"), "n", kind.alias("kind")).where("kind is not null")


def contamination(spark: SparkSession, docs: DataFrame, items: DataFrame, width: int = 8, slop: int = 2, least_items: int = 2, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, item_ids (sorted as strings), n_near, contaminated, mark (of the text) for each row of docs."""
    found = written(matches(spark, docs, items, width, slop, id_col, text_col, item_id, item_text), spark, "decontam-matches")
    spans = F.array_sort(F.collect_set(F.when(F.col("kind") == "phrase", F.struct("start", (F.col("start") + F.col("n")).alias("end")))))
    covered = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("hit")),
        lambda s, x: F.struct(F.greatest(s["end"], x["end"]).alias("end"), (s["hit"] + F.greatest(x["end"] - F.greatest(x["start"], s["end"]), F.lit(0))).alias("hit")),
        lambda s: s["hit"],
    )
    hits = found.groupBy(*ROW).agg(covered.cast("long").alias("n_hit"), F.count_distinct(F.when(F.col("kind") == "near", F.col("phrase"))).alias("n_near"))
    of_items = found.where("kind = 'phrase'").select(*ROW, "phrase").distinct().join(item_windows(items, width, item_id, item_text).select("phrase", F.col("item_id").cast("string").alias("item")), "phrase")
    named = of_items.groupBy(*ROW).agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    hits = written(of_rows(hits, named, "left"), spark, "decontam-hits")
    base = _rows(docs, id_col, text_col).select(*ROW, F.size("words").cast("long").alias("n_words"))
    out = of_rows(base, hits, "left")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), F.coalesce("n_near", F.lit(0)).alias("n_near"), (F.size(ids) >= least_items).alias("contaminated"), "mark")
