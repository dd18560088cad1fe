"""Packing of documents into sequences of several permitted lengths.

Texts longer than the largest length are cut into pieces of it. Pieces are dealt by a hash of
their place in the table, so that no id can crowd one, into shards of about SHARD_PIECES; in a shard they come by falling length, each into the open bin that
it fills best. A new bin gets the size of least cost for each byte that it could hold of what is
left (a bin costs its size and a fixed overhead), so the sizes are chosen jointly with what
remains; in the end each bin is cut down to the smallest permitted size for its contents.

Edge cases: null and empty texts are one row of length 0 without a bin; equal lengths go by id,
then piece; repeated rows are packed like others, and so are rows without an id or with a shared
one, however many; a very long text is many pieces, dealt over all shards; tables without rows
give none; other columns are ignored. No piece is dropped or cut short.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm.common import written

SIZES = (2048, 4096, 8192, 16384)
OVERHEAD = 64
SHARD_PIECES = 10_000


def pack(lengths: list[int], sizes: tuple[int, ...] = SIZES, overhead: int = OVERHEAD) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each length (given in falling order), and the size of each bin."""
    left = sorted(lengths)
    bins: list[int] = []
    used: list[int] = []
    free: list[tuple[int, int]] = []
    of, at = [], []
    for n in lengths:
        left.pop(bisect_right(left, n) - 1)
        k = bisect_left(free, (n, -1))
        if k < len(free):
            room, b = free.pop(k)
        else:
            b, room = len(bins), _opened(n, left, sizes, overhead)
            bins.append(room)
            used.append(0)
        of.append(b)
        at.append(used[b])
        used[b] += n
        if room > n:
            insort(free, (room - n, b))
    return of, at, [min(s for s in sizes if s >= u) for u in used]


def _opened(n: int, left: list[int], sizes: tuple[int, ...], overhead: int) -> int:
    """The size whose cost for each byte held is least, if the longest of what is left go in as they fit; the larger of equals."""
    best, chosen = None, 0
    for size in sorted(sizes, reverse=True):
        if size < n:
            continue
        held, top = n, len(left)
        while held < size and top:
            top = bisect_right(left, size - held, 0, top)
            if top:
                top -= 1
                held += left[top]
        cost = (size + overhead) / held
        if best is None or cost < best:
            best, chosen = cost, size
    return chosen


def pieces(df: DataFrame, length: Column, id_col: str = "doc_id", most: int = SIZES[-1]) -> DataFrame:
    """doc_id, piece, start, length: one row for each piece, and one of length 0 for an empty text."""
    n = F.coalesce(length, F.lit(0)).cast("long")
    cut = df.select(F.col(id_col).cast("long").alias("doc_id"), n.alias("n"))
    cut = cut.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("n") / most) - 1, F.lit(0)).cast("long"))).alias("piece"))
    return cut.select("doc_id", "piece", (F.col("piece") * most).alias("start"), F.least(F.col("n") - F.col("piece") * most, F.lit(most)).alias("length"))


def packed(spark: SparkSession, df: DataFrame, length: Column, id_col: str = "doc_id", sizes: tuple[int, ...] = SIZES, overhead: int = OVERHEAD) -> DataFrame:
    """doc_id, piece, start, length, bin_id, bin_offset, bin_size for each piece; length is the column to pack by."""
    all_pieces = written(pieces(df, length, id_col, max(sizes)).withColumn("place", F.monotonically_increasing_id()), spark, "pack-pieces")
    shards = max(1, -(-all_pieces.where("length > 0").count() // SHARD_PIECES))
    full = all_pieces.where("length > 0").withColumn("shard", F.pmod(F.xxhash64("place"), F.lit(shards)))
    dealt = full.repartition("shard").sortWithinPartitions("shard", F.desc("length"), "doc_id", "piece", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shards come one after another; each is about SHARD_PIECES rows."""
        held: list[pa.RecordBatch] = []

        def done() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks()
            of, at, size = pack(rows.column("length").to_pylist(), sizes, overhead)
            ids = (rows.column("shard").to_numpy().astype(np.int64) << 32) + np.array(of, np.int64)
            out = rows.select(["doc_id", "piece", "start", "length"]).append_column("bin_id", pa.array(ids)).append_column("bin_offset", pa.array(at, pa.int64())).append_column("bin_size", pa.array([size[b] for b in of], pa.int64()))
            yield from out.to_batches()

        for batch in batches:
            shard = batch.column("shard").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(shard)) + 1), len(shard)]
            for a, b in zip(edges[:-1], edges[1:]):
                if a < b:
                    if held and held[-1].column("shard")[0].as_py() != shard[a]:
                        yield from done()
                        held = []
                    held.append(batch.slice(a, b - a))
        if held:
            yield from done()

    out = dealt.mapInArrow(run, "doc_id long, piece long, start long, length long, bin_id long, bin_offset long, bin_size long")
    none = F.lit(None).cast("long")
    return out.union(all_pieces.where("length = 0").select("doc_id", "piece", "start", "length", none, none, none))
