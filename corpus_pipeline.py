"""The corpus pipeline: quality classifier, line dedup, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and but for
the last returns the columns of `documents`. Stages are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vecloom.llm.common import mark_of, table, written
from vecloom.llm.decontam import contamination
from vecloom.llm.lines import drop_boilerplate
from vecloom.llm.neardup import near_duplicates
from vecloom.llm.packing import packed
from vecloom.llm.quality import fit_quality, quality_scores

QUALITY_CUT = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    model = fit_quality(spark, docs, table(spark, sf_dir, "labels"))
    scored = quality_scores(docs, model, keep=docs.columns, text_back=True)
    return scored.where(F.col("score") >= QUALITY_CUT).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that their source repeats on a large share of its documents."""
    cut = drop_boilerplate(spark, docs, "source", "text")
    size = F.when(F.col("n_lines_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", size).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near-duplicates.

    Of rows that share that id, the one with the least text hash stays, and of rows with one id and
    one text the first by the other columns. Documents without words or without an id all stay.
    """
    found = written(near_duplicates(spark, docs).select("doc_id", "mark", "part", "kept"), spark, "pipeline-near")
    again = found.where("kept and part is not null").groupBy("part").agg(F.count("*").alias("rows"), F.min("mark").alias("first")).where("rows > 1")
    again = written(again, spark, "pipeline-again")
    dropped = found.where("not kept")
    if again.isEmpty():
        return _without(spark, docs, dropped)
    shared = found.where("kept").join(again, "part")
    left = _without(spark, docs, dropped.union(shared.where("mark <> first").select(*dropped.columns)))
    one = shared.where("mark = first").select("doc_id", "mark").distinct()
    plain, names, same = _renamed(docs)
    order = Window.partitionBy(names["doc_id"], mark_of(F.col(names["text"]))).orderBy(*[F.col(c).cast("string") for c in names.values()])
    first = plain.join(one, same(one), "left_semi").withColumn("place", F.row_number().over(order)).where("place = 1")
    return _without(spark, left, one).union(first.select(*names.values()).toDF(*docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item: one window of eight words, or the whole of a shorter item, is enough."""
    found = contamination(spark, docs, table(spark, sf_dir, "benchmark"), least_items=1)
    return _without(spark, docs, found.where("contaminated"))


def _renamed(docs: DataFrame):
    """docs under names that clash with none made here, those names, and the condition that a row is one of a table of doc_id and mark."""
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    plain = docs.toDF(*names.values())
    return plain, names, lambda found: plain[names["doc_id"]].eqNullSafe(found["doc_id"]) & (mark_of(plain[names["text"]]) == found["mark"])


def _without(spark: SparkSession, docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs without these rows (doc_id and mark), which are broadcast only if they are few."""
    dropped = written(dropped.select("doc_id", "mark").distinct(), spark, "pipeline-dropped")
    plain, _, same = _renamed(docs)
    return plain.join(F.broadcast(dropped) if dropped.count() <= 2_000_000 else dropped, same(dropped), "left_anti").toDF(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, bin_id, bin_offset, bin_size: the documents packed by their UTF-8 bytes."""
    return packed(spark, docs, F.octet_length("text"))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]
#: The classifier and the packing are no SQL; tests compare the pipeline with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, spark, f"pipeline-{name}")
    return docs
