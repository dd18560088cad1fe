"""Removal of long repeated byte strings with a logarithmic family of sparse suffix arrays.

The suffixes that are indexed start at *anchors*: in every window of LENGTH bytes the GRAM-byte
string with the least hash. Equal windows have the same anchor, so every repeat of LENGTH bytes
meets in one. The windows with one anchor make up a *span*; an index entry is the anchor's hash
and the span's hash, and a sorted run of distinct entries with their counts is the suffix array
of a batch. A new batch is sorted, merge-scanned against every level for anchors that occur in
both, and added: levels of equal size merge, so after b batches there are at most log2(b) + 1.

A span that occurs twice is repeated as a whole. Where only the anchor is shared, the windows
of the different spans are compared one by one, each as a hash that is counted before it is
shuffled. Groups of copies therefore cost one entry to a batch and partition.

Edge cases: null and empty texts have no bytes; texts shorter than LENGTH keep everything;
repeated rows count as other places; rows that share an id are told apart; null ids are kept;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm.common import mark_of, written
from vecloom.llm.hashing import chunks, mixed, range_hashes

LENGTH, GRAM = 200, 64
#: Texts are cut for indexing into pieces of so many window starts.
PIECE = 1 << 22
POSITION_BITS = np.uint64(24)
#: Places to look at again, or spans to remove, are broadcast up to so many bytes; beyond that the texts are shuffled to them.
BROADCAST_BYTES = 64 << 20
#: Anchors with more different spans are compared window by window through a shuffle, not in one task.
FEW_SPANS = 256
#: At most so many anchors are dealt into parts.
HOT_ANCHORS = 1 << 18


def least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values."""
    n = len(values)
    full = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = values
    blocks = full.reshape(-1, width)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[: n - width + 1], head[width - 1 : n])


def anchored_spans(data: np.ndarray, starts: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """row, first window start (in data), number of starts, anchor hash, span hash."""
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    sums, inv = range_hashes(data)
    grams = mixed((sums[gram:] - sums[:-gram]) * inv[: n - gram + 1])
    packed = grams >> POSITION_BITS << POSITION_BITS | np.arange(n - gram + 1, dtype=np.uint64)
    least = least_in_windows(packed, length - gram + 1)
    at = (least & np.uint64((1 << int(POSITION_BITS)) - 1)).astype(np.int64)
    new = np.ones(n - length + 1, bool)
    new[1:] = at[1:] != at[:-1]
    valid = np.zeros(n - length + 2, bool)
    for a, b in zip(starts[:-1], starts[1:]):
        if b - a >= length:
            valid[a : b - length + 1] = True
            new[a] = True
    first = np.flatnonzero(new & valid[:-1])
    ends = np.flatnonzero(valid[:-1] & ~valid[1:]) + 1
    last = np.append(first[1:], n)
    last = np.minimum(last, ends[np.searchsorted(ends, first, "right")]) if len(first) else last[:0]
    view, digest = memoryview(data), xxhash.xxh3_64_intdigest
    spans = np.fromiter((digest(view[a:b]) for a, b in zip(first.tolist(), (last + (length - 1)).tolist())), np.uint64, len(first))
    return np.searchsorted(starts, first, "right") - 1, first, last - first, grams[at[first]], spans


def pieces(texts: pa.Array, length: int = LENGTH) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """As chunks(), with long texts cut into pieces that share length - 1 bytes; third comes the offset in the text."""
    for first, end, data, starts in chunks(texts):
        if len(data) <= PIECE + length:
            yield first, end, 0, data, starts
        else:
            for at in range(0, len(data) - length + 1, PIECE):
                part = data[at : at + PIECE + length - 1]
                yield first, end, at, part, np.array([0, len(part)])


def span_table(docs: DataFrame, batches: int, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per span: doc_id, h (64 bits of the text, for rows that share an id), lo, n, anchor, span, batch."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for first, end, off, data, starts in pieces(batch.column(2), length):
                row, lo, n, anchor, span = anchored_spans(data, starts, length, gram)
                take = pa.array(row + first)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array((lo - starts[row] + off).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(span.view(np.int64))], names=["doc_id", "h", "lo", "n", "anchor", "span"])

    out = keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, h long, lo int, n int, anchor long, span long")
    return out.withColumn("batch", F.pmod(F.hash("doc_id"), F.lit(batches)))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("doc_id"), mark_of(text).alias("h"), text.alias("text"))


class SuffixFamily:
    """Levels of sorted runs (anchor, span, count); level k holds 2**k batches."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.levels: dict[int, DataFrame] = {}
        self.found: list[DataFrame] = []

    def add(self, entries: DataFrame) -> None:
        """Sort a batch's entries, scan them against every level, and merge levels of one size."""
        run = entries.groupBy("anchor", "span").agg(F.count("*").alias("copies"))
        run = written(run.sortWithinPartitions("anchor", "span"), self.spark, "suffix-run")
        # One row an anchor, counted before the shuffle, on both sides of a scan.
        own = run.groupBy("anchor").agg(F.count("*").alias("rows"), F.sum("copies").alias("copies"))
        self.found.append(own.where("copies > 1").select("anchor", "rows"))
        for level in self.levels.values():
            there = level.groupBy("anchor").agg(F.count("*").alias("there"))
            self.found.append(there.join(own, "anchor").select("anchor", (F.col("there") + F.col("rows")).alias("rows")))
        k = 0
        while k in self.levels:
            both = self.levels.pop(k).union(run).groupBy("anchor", "span").agg(F.sum("copies").alias("copies"))
            run, k = written(both.sortWithinPartitions("anchor", "span"), self.spark, f"suffix-level{k + 1}"), k + 1
            self.found = [written(self.shared(), self.spark, "suffix-found")]
        self.levels[k] = run

    def shared(self) -> DataFrame:
        """anchor, rows: the anchors that the scans found, and at least as many rows as they have in all levels."""
        return _union(self.found).groupBy("anchor").agg(F.sum("rows").alias("rows"))

    def repeats(self) -> DataFrame:
        """anchor, span, copies, spans (different ones at the anchor) for what may occur twice.

        An anchor's rows are dealt into parts of about FEW_SPANS, or of 1 / HOT_ANCHORS of all rows if
        that is more, so at most HOT_ANCHORS anchors have several parts, whatever the input, and only those are broadcast.
        """
        shared = written(self.shared(), self.spark, "suffix-shared")
        limit = max(FEW_SPANS, -(-(shared.agg(F.sum("rows")).head()[0] or 0) // HOT_ANCHORS))
        hot = F.broadcast(shared.where(F.col("rows") > limit).select("anchor", F.ceil(F.col("rows") / limit).alias("parts")))
        parts = F.coalesce("parts", F.lit(1))
        keys = shared.join(hot, "anchor", "left").select("anchor", F.explode(F.sequence(F.lit(0), (parts - 1).cast("int"))).alias("part"))
        dealt = _union(list(self.levels.values())).join(hot, "anchor", "left").select("anchor", F.pmod(F.xxhash64("span"), parts).cast("int").alias("part"), "span", "copies")
        spans = dealt.join(keys, ["anchor", "part"], "left_semi").groupBy("anchor", "part", "span").agg(F.sum("copies").alias("copies"))
        spans = written(spans, self.spark, "suffix-spans")
        sizes = spans.groupBy("anchor", "part").agg(F.count("*").alias("n"))
        sizes = sizes.groupBy("anchor").agg(F.sum("n").alias("spans"), F.collect_list("part").alias("part"))
        sizes = sizes.select("anchor", "spans", F.explode("part").alias("part"))
        return written(spans.join(sizes, ["anchor", "part"]).where("copies > 1 or spans > 1").drop("part"), self.spark, "suffix-repeats")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _beside(docs: DataFrame, lists: DataFrame, spark: SparkSession, how: str) -> DataFrame:
    """docs with the lists of their rows; the lists are broadcast only if measured to be small."""
    size = lists.agg(F.coalesce(F.sum(F.length("list") + 64), F.lit(0))).head()[0]
    return docs.join(F.broadcast(lists) if size <= BROADCAST_BYTES else lists, ["doc_id", "h"], how)


BLOCK = 8
WHERE = np.dtype([("lo", "<i4"), ("n", "<i4"), ("anchor", "<i8"), ("span", "<i8"), ("spans", "<i8"), ("copies", "<i8")])


def _packed(rows: DataFrame, columns: list[str], dtype: np.dtype) -> DataFrame:
    """Each text's rows as one binary list, made in Python from arrays of equal length."""
    grouped = rows.groupBy("doc_id", "h").agg(F.collect_list(F.struct(*columns)).alias("x")).select("doc_id", "h", *[F.col(f"x.{c}").alias(c) for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(c) for c in columns]
            flat = np.zeros(len(lists[0].flatten()), dtype)
            for c, x in zip(columns, lists):
                flat[c] = x.flatten().to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.cumsum(lists[0].value_lengths().to_numpy(zero_copy_only=False))]).astype(int)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([_merged(flat[a:b]) for a, b in zip(at[:-1], at[1:])], pa.binary())], names=["doc_id", "h", "list"])

    return grouped.mapInArrow(run, "doc_id long, h long, list binary")


def _merged(rows: np.ndarray) -> bytes:
    """Ranges (lo, n) of one text joined where they touch; other lists as they are."""
    if rows.dtype.names != ("lo", "n"):
        return rows.tobytes()
    rows = rows[np.argsort(rows["lo"], kind="stable")]
    end = np.maximum.accumulate(rows["lo"] + rows["n"])
    new = np.concatenate([[True], rows["lo"][1:] > end[:-1]])
    first = np.flatnonzero(new)
    out = np.stack([rows["lo"][first], end[np.append(first[1:], len(rows)) - 1]], axis=1)
    return out.astype("<i4").tobytes()


def _window_hashes(raw: list[bytes], anchors: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start in the row's span, and hash (with the anchor) of every window of the spans."""
    sizes = np.array([len(r) for r in raw]) - length + 1
    starts = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    sums, inv = range_hashes(np.frombuffer(b"".join(raw), np.uint8))
    row = np.repeat(np.arange(len(raw)), sizes)
    rel = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = starts[row] + rel
    return row, rel, mixed((sums[at + length] - sums[at]) * inv[at]) ^ mixed(anchors[row])


def repeated_parts(spark: SparkSession, docs: DataFrame, marked: DataFrame, length: int, gram: int) -> DataFrame:
    """anchor, span, lo, n: the repeated windows of spans that occur once, at anchors that occur more often."""
    place = F.min(F.struct("doc_id", "h", "lo", "n", "spans", "copies")).alias("p")
    wanted = marked.where("spans > 1").groupBy("anchor", "span").agg(place).select("p.*", "anchor", "span")
    lists = written(_packed(wanted, list(WHERE.names), WHERE), spark, "suffix-wanted")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                text, where = batch.column("text")[k].as_py().encode("utf-8"), np.frombuffer(batch.column("list")[k].as_py(), WHERE)
                for a in range(0, len(where), 20_000):
                    w = where[a : a + 20_000]
                    raw = [text[x : x + n + length - 1] for x, n in zip(w["lo"].tolist(), w["n"].tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(w["anchor"]), pa.array(w["span"]), pa.array(w["spans"]), pa.array(w["copies"]), pa.array(raw, pa.binary())], names=["anchor", "span", "spans", "copies", "raw"])

    spans = written(_beside(docs, lists, spark, "inner").mapInArrow(cut, "anchor long, span long, spans long, copies long, raw binary"), spark, "suffix-contents")

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in chain(_sized(batches), [None]):
            table = pa.Table.from_batches([batch]) if batch is not None else None
            table = pa.concat_tables([held, table]) if held is not None and table is not None else table if table is not None else held
            if table is None or table.num_rows == 0:
                continue
            anchors = table.column("anchor").to_numpy()
            ready = table.num_rows if batch is None else int(np.searchsorted(anchors, anchors[-1]))
            held = table.slice(ready) if batch is not None else None
            if ready:
                yield from shared(table.slice(0, ready), anchors[:ready].view(np.uint64))

    def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4000):
                yield batch.slice(a, 4000)

    def shared(table: pa.Table, anchors: np.ndarray) -> Iterator[pa.RecordBatch]:
        row, rel, h = _window_hashes(table.column("raw").to_pylist(), anchors, length)
        _, at, count = np.unique(h, return_inverse=True, return_counts=True)
        single = table.column("copies").to_numpy() == 1
        keep = (count[at] > 1) & single[row]
        if keep.any():
            row, rel = row[keep], rel[keep]
            cutpoint = np.flatnonzero((np.diff(row) != 0) | (np.diff(rel) != 1)) + 1
            first = np.concatenate([[0], cutpoint])
            last = np.concatenate([cutpoint - 1, [len(row) - 1]])
            take = pa.array(row[first])
            yield pa.RecordBatch.from_arrays([table.column("anchor").take(take).combine_chunks(), table.column("span").take(take).combine_chunks(), pa.array(rel[first].astype(np.int32)), pa.array((rel[last] - rel[first] + 1).astype(np.int32))], names=["anchor", "span", "lo", "n"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each span's windows in blocks by their distance to the anchor, with a hash of all the block's bytes, of those that any window of the block has, and of each window."""
        for batch in _sized(batches):
            if batch.num_rows:
                raw, anchors = batch.column("raw").to_pylist(), batch.column("anchor").to_numpy().view(np.uint64)
                row, rel, h = _window_hashes(raw, anchors, length)
                place = _places(raw, anchors, gram)
                block = (place[row] - rel) // BLOCK
                first = np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(block) != 0)]))
                n = np.diff(np.append(first, len(row)))
                hulls = [xxhash.xxh3_64_intdigest(raw[r][a : a + k + length - 1]) for r, a, k in zip(row[first].tolist(), rel[first].tolist(), n.tolist())]
                ends = place[row[first]] - BLOCK * block[first]  # the last start of a whole block
                cores = [xxhash.xxh3_64_intdigest(raw[r][e : e - BLOCK + 1 + length], j & 0xFFFF) for r, e, j in zip(row[first].tolist(), ends.tolist(), block[first].tolist())]
                take = pa.array(row[first])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("anchor", "span", "copies")), pa.array(rel[first].astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(np.array(hulls, np.uint64).view(np.int64)), pa.array(np.array(cores, np.uint64).view(np.int64)), pa.ListArray.from_arrays(np.append(first, len(row)).astype(np.int32), h.view(np.int64))], names=["anchor", "span", "copies", "lo", "n", "hull", "core", "windows"])

    local = spans.where(F.col("spans") <= FEW_SPANS).repartition("anchor").sortWithinPartitions("anchor").mapInArrow(few, "anchor long, span long, lo int, n int")
    crowd = spans.where(F.col("spans") > FEW_SPANS)
    if crowd.isEmpty():
        return local
    cut_up = written(crowd.mapInArrow(blocks, "anchor long, span long, copies long, lo int, n int, hull long, core long, windows array<long>"), spark, "suffix-blocks")
    alike = cut_up.groupBy("anchor", "hull").agg(F.count("*").alias("c"), F.min("span").alias("first"))
    # Equal windows lie in blocks with one core; a block whose core is its own alone has no repeated window.
    cores = cut_up.groupBy("anchor", "core").agg(F.count_distinct("hull").alias("kinds"))
    told = written(cut_up.join(alike, ["anchor", "hull"]).join(cores, ["anchor", "core"]), spark, "suffix-told")
    whole = told.where("c > 1 and copies = 1").select("anchor", "span", "lo", "n")
    # Of blocks that are alike, one stands for all where single windows are compared.
    windows = told.where("kinds > 1 and (c = 1 or span = first)").select("anchor", "span", "lo", (F.expr("c = 1 and copies = 1")).alias("open"), F.posexplode("windows").alias("pos", "w"))
    twice = windows.groupBy("anchor", "w").agg(F.count("*").alias("c")).where("c > 1").select("anchor", "w")
    single = windows.where("open").join(twice, ["anchor", "w"]).select("anchor", "span", (F.col("lo") + F.col("pos")).alias("lo"), F.lit(1).alias("n"))
    return local.union(whole).union(single)


def _places(raw: list[bytes], anchors: np.ndarray, gram: int) -> np.ndarray:
    """Where in its span each anchor first stands."""
    starts = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    sums, inv = range_hashes(np.frombuffer(b"".join(raw), np.uint8))
    grams = mixed((sums[gram:] - sums[:-gram]) * inv[: len(sums) - gram])
    of = np.repeat(np.arange(len(raw)), np.diff(starts))[: len(grams)]
    hit = np.flatnonzero((grams == anchors[of]) & (np.arange(len(grams)) + gram <= starts[of + 1]))
    out = np.zeros(len(raw), np.int64)
    out[of[hit][::-1]] = (hit - starts[of[hit]])[::-1]
    return out


def repeated_ranges(spark: SparkSession, docs: DataFrame, batches: int = 4, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, h, list: byte ranges (first, end as int32 pairs) covered by strings of `length` bytes that start elsewhere too."""
    entries = written(span_table(docs, batches, id_col, text_col, length, gram), spark, "suffix-entries")
    family = SuffixFamily(spark)
    for b in range(batches):
        family.add(entries.where(F.col("batch") == b))
    marked = written(entries.drop("batch").join(family.repeats(), ["anchor", "span"]), spark, "suffix-marked")
    whole = marked.where("copies > 1").select("doc_id", "h", "lo", (F.col("n") + length - 1).alias("n"))
    parts = repeated_parts(spark, keyed(docs, id_col, text_col), marked, length, gram)
    part = marked.where("copies = 1").select("doc_id", "h", F.col("lo").alias("at"), "anchor", "span").join(parts, ["anchor", "span"])
    part = part.select("doc_id", "h", (F.col("at") + F.col("lo")).alias("lo"), (F.col("n") + length - 1).alias("n"))
    return written(_packed(whole.union(part), ["lo", "n"], np.dtype([("lo", "<i4"), ("n", "<i4")])), spark, "suffix-ranges")


def without_repeats(spark: SparkSession, docs: DataFrame, batches: int = 4, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, kept_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with kept_bytes, what is left of each text."""
    ranges = repeated_ranges(spark, docs, batches, id_col, text_col, length, gram)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            sizes, removed, spans, digests, left = [], [], [], [], []
            for k in range(batch.num_rows):
                raw, cuts = batch.column("text")[k].as_py().encode("utf-8"), batch.column("list")[k].as_py()
                cuts = np.frombuffer(cuts, "<i4").reshape(-1, 2).tolist() if cuts else []
                edges = [0, *(x for c in cuts for x in c), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])) if cuts else raw
                sizes.append(len(raw))
                removed.append(len(raw) - len(kept))
                spans.append(len(cuts))
                digests.append(hashlib.sha256(kept).hexdigest())
                left.append(kept)
            out = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(out + ([pa.array(left, pa.binary())] if kept_bytes else []), names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + (["kept"] if kept_bytes else []))

    out = _beside(keyed(docs, id_col, text_col), ranges, spark, "left").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if kept_bytes else ""))
    return out.withColumn("doc_id", F.when(F.col("doc_id") != -(2**63), F.col("doc_id")))
