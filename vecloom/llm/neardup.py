"""Near-duplicate documents with HyperMinHash sketches.

Each text's set of word shingles is reduced to registers of a leading-zero count and a few
mantissa bits. Texts with one and the same set form a class at once. Bands of registers put
classes into buckets; in each bucket every member whose collision-corrected register estimate
allows a link is compared with one pivot on the full sets, and the links give components.
Texts of one pivot that are still in different components are then compared with each other,
exactly, by their short differences to the pivot. So a group of near copies costs about its size, and no pair is cut off.

Sets are of 64-bit hashes of shingles, and links are confirmed on all of both sets' hashes.

Edge cases: null texts count as empty; empty texts and texts without words have an empty set
and link with nothing; texts with fewer words than a shingle are one shingle; repeated rows
are copies; rows that share an id but not a text are documents of their own, and a component's
id is the smallest doc_id in it; rows with a null id keep a null component and link with nothing;
a similarity of exactly the threshold links; a very long text's set is held by one task; tables
without rows give none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm.common import mark_of, written
from vecloom.llm.components import components
from vecloom.llm.hashing import chunks, mixed, word_hashes

WIDTH = 5
BANDS, ROWS = 48, 4
REGISTERS = BANDS * ROWS
MANTISSA = 10
#: Sketches rule out a pair only if the estimate is below the threshold by so much (over six standard errors) and both sets are of this size.
MARGIN, LEAST_FOR_ESTIMATE = 0.25, 256
#: Ids of candidate texts are broadcast if they are at most so many.
BROADCAST_IDS = 2_000_000
#: At most so many components are broadcast, each of more than FEW_ROWS different sets.
HOT_PARTS, FEW_ROWS = 1 << 18, 256
#: A pivot's texts are compared in parts of about so many.
SPLIT = 128


def shingles(data: np.ndarray, starts: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Row and 64-bit hash of each shingle, not yet distinct; rows in order."""
    row, word, _, _ = word_hashes(data, starts)
    salt = mixed(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
    n = len(word)
    full = max(n - width + 1, 0)
    h = np.zeros(full, np.uint64)
    for k in range(width):
        h += word[k : k + full] * salt[k]
    whole = row[:full] == row[width - 1 : width - 1 + full] if full else np.zeros(0, bool)
    rows, out = row[:full][whole], mixed(h[whole])
    count = np.bincount(row, minlength=len(starts) - 1) if n else np.zeros(len(starts) - 1, int)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        first = np.searchsorted(row, short)
        extra = np.array([np.sum(word[f : f + c] * salt[:c], dtype=np.uint64) + np.uint64(c) for f, c in zip(first, count[short])], np.uint64)
        rows, out = np.concatenate([rows, short]), np.concatenate([out, mixed(extra)])
        order = np.argsort(rows, kind="stable")
        rows, out = rows[order], out[order]
    return rows, out


def sketch(distinct: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of a non-empty set of hashes; empty registers borrow from a fixed sequence of others."""
    at = ((distinct >> np.uint64(32)) % np.uint64(REGISTERS)).astype(np.int64)
    rest = mixed(distinct) >> np.uint64(1)
    least = np.full(REGISTERS, np.iinfo(np.int64).max)
    np.minimum.at(least, at, rest.astype(np.int64))
    empty = least == np.iinfo(np.int64).max
    zeros = 63 - np.frexp(least.astype(np.float64))[1]
    zeros = np.clip(zeros, 0, 50)
    mantissa = (least << (zeros + 1)) >> (63 - MANTISSA) & ((1 << MANTISSA) - 1)
    out = (zeros << MANTISSA | mantissa).astype(np.uint16)
    if empty.any():
        for i in np.flatnonzero(empty):
            order = _borrow(int(i))
            out[i] = out[order[np.argmax(~empty[order])]]
    return out


_orders: dict[int, np.ndarray] = {}


def _borrow(i: int) -> np.ndarray:
    if i not in _orders:
        _orders[i] = np.argsort(mixed(np.arange(REGISTERS, dtype=np.uint64) + np.uint64(1000 * (i + 1))))
    return _orders[i]


def _chance(n: float, m: float) -> float:
    """Chance that two disjoint sets with n and m elements to a register agree in it: the sum over register values."""
    zeros = np.arange(0, 40)[:, None]
    low = 2.0 ** -(zeros + 1) * (1 + np.arange(1 << MANTISSA)[None, :] / (1 << MANTISSA))
    high = low + 2.0 ** -(zeros + 1 + MANTISSA)
    within = lambda k: np.exp(k * np.log1p(-low)) - np.exp(k * np.log1p(-np.minimum(high, 1 - 1e-15)))
    return float(np.sum(within(n) * within(m)))


def chance_table() -> np.ndarray:
    """_chance by the rounded binary logarithms of both sizes."""
    size = 2.0 ** np.arange(24) / REGISTERS
    return np.array([[_chance(max(a, 1.0), max(b, 1.0)) for b in size] for a in size])


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Jaccard similarity from registers (one row a pair), less the agreements that chance alone gives."""
    share = np.mean(a == b, axis=1)
    log = lambda x: np.clip(np.rint(np.log2(np.maximum(x, 1))), 0, len(table) - 1).astype(int)
    chance = table[log(n), log(m)]
    return np.clip((share - chance) / (1 - chance), 0, 1)


def print_of(distinct: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(distinct.tobytes())


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, mark (of the text), n_shingles, print (128 bits of the whole set), sketch; the last two null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, prints, out = [], [], []
            for first, end, data, starts in chunks(batch.column(2)):
                rows, h = shingles(data, starts)
                cut = np.searchsorted(rows, np.arange(end - first + 1))
                for k in range(end - first):
                    own = np.unique(h[cut[k] : cut[k + 1]])
                    sizes.append(len(own))
                    prints.append(print_of(own) if len(own) else None)
                    out.append(sketch(own).tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(out, pa.binary())], names=["doc_id", "mark", "n_shingles", "print", "sketch"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), mark_of(F.col(text_col)).alias("mark"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, mark long, n_shingles long, print binary, sketch binary")


def shingle_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, print, items: the whole set of 64-bit shingle hashes; no row for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, starts in chunks(batch.column(1)):
                rows, h = shingles(data, starts)
                cut = np.searchsorted(rows, np.arange(end - first + 1))
                take = [k for k in range(end - first) if cut[k] < cut[k + 1]]
                sets = [np.unique(h[cut[k] : cut[k + 1]]) for k in take]
                flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                ids = batch.column(0).take(pa.array([first + k for k in take], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([print_of(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(offsets, flat)], names=["doc_id", "print", "items"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, print binary, items array<long>")


def plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes allow a link and whose sketches don't rule it out."""
    side = lambda k: classes.select(F.col("rep").alias(k), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"s_{k}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    table, least = chance_table(), percent / 100 - MARGIN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            n, m = (batch.column(k).to_numpy() for k in ("n_a", "n_b"))
            regs = [np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, REGISTERS) for k in ("s_a", "s_b")]
            keep = (estimate(regs[0], regs[1], n, m, table) >= least) | (np.minimum(n, m) < LEAST_FOR_ESTIMATE)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return sized.mapInArrow(run, "a long, b long")


def sets_of(spark: SparkSession, docs: DataFrame, classes: DataFrame, pairs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """rep, items: the full sets of all classes in pairs (a, b), each from the text of its smallest id."""
    reps = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    wanted = written(classes.select("rep", "doc_id", "print").join(reps, "rep", "left_semi"), spark, "near-wanted")
    ids = wanted.select("doc_id").distinct()
    small = F.broadcast(ids) if wanted.count() <= BROADCAST_IDS else ids
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(small, "doc_id", "left_semi")
    found = shingle_sets(texts, "doc_id").join(wanted, ["doc_id", "print"])  # another text of that id has another print
    return written(found.select("rep", "items").dropDuplicates(["rep"]), spark, "near-sets")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked, by their full sets."""
    side = lambda k: sets.select(F.col("rep").alias(k), F.col("items").alias(f"i_{k}"))
    both = F.size(F.array_intersect("i_a", "i_b"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", both.alias("both"), (F.size("i_a") + F.size("i_b")).alias("sum"))
    return joined.where(F.col("both") * 100 >= (F.col("sum") - F.col("both")) * percent).select("a", "b")


def common_items(sets: DataFrame, reps: DataFrame) -> DataFrame:
    """rep, size, common: the items that any other set of reps has too. Counted before the shuffle, and linear."""
    own = sets.join(reps, "rep", "left_semi")
    placed = own.select("rep", F.explode("items").alias("item"))
    twice = placed.groupBy("item").agg(F.count("*").alias("c")).where("c > 1").select("item")
    common = placed.join(twice, "item").groupBy("rep").agg(F.collect_list("item").alias("common"))
    return own.select("rep", F.size("items").alias("size")).join(common, "rep", "left").withColumn("common", F.coalesce("common", F.array().cast("array<long>")))


def links_left_open(spark: SparkSession, stars: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Linked pairs among texts of one pivot that are still in different components.

    Each text is written as its difference to the pivot (what it lacks of the pivot's set, or what it
    has of it, and what it has beside), so a pair's overlap follows exactly from short lists and is
    tested inside the join; only linked pairs come out.
    """
    told = stars.select(F.col("a").alias("pivot"), F.col("b").alias("rep")).join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left")
    told = told.select("pivot", "rep", F.coalesce("component", "rep").alias("component"))
    sizes = told.groupBy("pivot", "component").count().groupBy("pivot").agg(F.max(F.struct("count", "component")).alias("m"), F.count("*").alias("parts"), F.sum("count").alias("n"))
    home = written(sizes.where("parts > 1").select("pivot", F.col("m.component").alias("main"), F.ceil(F.col("n") / SPLIT).cast("int").alias("salts")), spark, "near-home")
    open_ = written(told.join(home, "pivot"), spark, "near-open")
    own = open_.join(common_items(sets, open_.select("rep").distinct()), "rep").join(sets.select(F.col("rep").alias("pivot"), F.col("items").alias("p")), "pivot")
    has = F.array_intersect("p", "common")
    own = own.withColumn("has", has).withColumn("near", F.size("has") * 2 >= F.size("p"))
    part = F.when(F.col("near"), F.array_except("p", "has")).otherwise(F.col("has"))
    own = own.select("pivot", "main", "salts", "rep", "component", "size", F.size("common").alias("shared"), F.size("p").alias("whole"), F.size("has").alias("held"), "near", part.alias("part"), F.array_except("common", "p").alias("beside"))
    own = written(own, spark, "near-differences")
    # A large group's texts are dealt into parts, and the few outside its main component meet every part.
    outer = own.where("component <> main").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    x, y = outer.alias("x"), own.withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int")).alias("y")
    col = lambda c: (F.col(f"x.{c}"), F.col(f"y.{c}"))
    enough = lambda o: o * 100 >= (F.col("x.size") + F.col("y.size") - o) * percent
    most = F.least(F.least(*col("shared")), F.least(*col("held")) + F.least(*map(F.size, col("beside"))))
    cross = F.size(F.array_intersect(*col("part")))
    in_pivot = F.when(F.col("x.near") & F.col("y.near"), F.col("x.held") + F.col("y.held") - F.col("x.whole") + cross)
    in_pivot = in_pivot.when(~F.col("x.near") & ~F.col("y.near"), cross).when(F.col("x.near"), F.col("y.held") - cross).otherwise(F.col("x.held") - cross)
    exact = in_pivot + F.size(F.array_intersect(*col("beside")))
    linked = (F.col("x.pivot") == F.col("y.pivot")) & (F.col("x.salt") == F.col("y.salt")) & (F.col("x.component") != F.col("y.component")) & enough(most) & enough(exact)
    return x.join(y, linked).select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()


def component_ids(spark: SparkSession, placed: DataFrame) -> DataFrame:
    """print, part, component_id: the smallest doc_id of each part, beside all its rows.

    Parts of more than 1 / HOT_PARTS of all rows, at most HOT_PARTS of them, are broadcast, so their rows don't meet in a task.
    """
    names = placed.groupBy("part").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("rows"))
    names = written(names, spark, "near-names")
    large = F.col("rows") > max(FEW_ROWS, -(-placed.count() // HOT_PARTS))
    rows, hot = placed.select("print", "part"), F.broadcast(names.where(large).drop("rows"))
    return rows.join(hot, "part").union(rows.join(hot, "part", "left_anti").join(names.drop("rows"), "part")).select("print", "part", "component_id")


def near_duplicates(spark: SparkSession, docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept, mark, part for each row: documents with 100 * shared >= percent * union are linked.

    mark tells apart rows that share an id, and part is the component's own number, which differs
    for components of one smallest id; null where a row links with nothing by rule.
    """
    base = written(sketches(docs, id_col, text_col), spark, "near-sketches")
    linkable = F.col("print").isNotNull() & F.col("doc_id").isNotNull()
    some = base.where(linkable)
    classes = some.groupBy("print").agg(F.min(F.struct("doc_id", "n_shingles", "sketch")).alias("x"))
    # Written once, so that rep stays what it is.
    classes = written(classes.select("print", F.monotonically_increasing_id().alias("rep"), F.col("x.doc_id").alias("doc_id"), F.col("x.n_shingles").alias("n"), "x.sketch"), spark, "near-classes")

    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.substring("sketch", k * (2 * ROWS) + 1, F.lit(2 * ROWS))))
    banded = classes.select("rep", F.explode(keys).alias("key"))
    buckets = banded.groupBy("key").agg(F.min("rep").alias("pivot"), F.count("*").alias("members")).where("members > 1").select("key", "pivot")
    members = written(banded.join(buckets, "key"), spark, "near-buckets")

    stars = written(members.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct(), spark, "near-stars")
    sets = sets_of(spark, docs, classes, stars, id_col, text_col)
    links = written(confirmed(plausible(stars, classes, percent), sets, percent), spark, "near-links")
    labels = components(spark, links)
    more = written(links_left_open(spark, stars, labels, sets, percent), spark, "near-more")
    if not more.isEmpty():
        labels = components(spark, links.union(more))

    placed = classes.select("print", "rep", "doc_id").join(labels.select(F.col("node").alias("rep"), F.col("component").alias("part")), "rep", "left")
    placed = written(placed, spark, "near-placed")
    single = placed.where("part is null").select("print", F.col("rep").alias("part"), F.col("doc_id").alias("component_id"))
    named = single.union(component_ids(spark, placed.where("part is not null")))
    out = some.select("doc_id", "n_shingles", "mark", "print").join(named, "print").select("doc_id", "n_shingles", "component_id", "mark", "part")
    # Rows without words, however many, don't meet in one key.
    alone = base.where(~linkable).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "mark", F.lit(None).cast("long").alias("part"))
    return out.union(alone).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "mark", "part")
