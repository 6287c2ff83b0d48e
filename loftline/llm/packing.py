"""Bulk-synchronous best-fit packing of tokenized documents into sequences of a fixed size.

All pieces of one length are interchangeable, and so are gaps of one size, so both are held as runs (size, number), in one
table: at most `capacity` runs of pieces, and about as many of gaps, however many documents there are.  At first as
many empty sequences are open as the tokens need at least.  In a round the runs are dealt to ranges of sizes, which are
keys and so don't depend on Spark's partitions, and every range is swept downward: a run of pieces takes its successor, the smallest gap that holds it, as often as
it fits.  Ranks settle conflicts: longer pieces come first, and the i-th piece of a run gets the i-th place of its gaps.
A gap is updated where it is taken; if it still lies in the range, later pieces of the sweep see it, else it goes to the
next round.  What has no gap waits for the next round too.  Each round has half as many ranges, so that ranges meet; if the
last one has pieces left, new sequences are opened for them.  Each match is an interval of ranks, and the pieces, whose
ranks their tasks know (count by task and length, summed over tasks), are joined to the intervals of their length.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, table, text_of
from .words import VOCABULARY, encoder, slices

CAPACITY = 2048
END = 0
#: Bytes of text that are encoded and cut into pieces at once.
SLICE = 1 << 22
#: Ranges of the first round.
RANGES = 8
#: kind: a gap (start: its first sequence), pieces without a place (start: their first rank), or a match.
GAP, PIECES, MATCH = 0, 1, 2
RUNS = "kind byte, size int, start long, n long, first long, each int, offset int"


def _pieces(batches: Iterator[pa.RecordBatch], capacity: int, vocabulary: str, end: int) -> Iterator[pa.RecordBatch]:
    task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
    for b, lo, texts in ((b, lo, part) for b in batches for lo, part in slices(b["text"], SLICE)):
        ids, n = encoder(vocabulary).encode(texts)
        out = np.full(len(ids) + len(n), end, "<u4")
        sizes = n + 1
        inside = np.ones(len(out), bool)
        inside[np.cumsum(sizes) - 1] = False
        out[inside] = ids
        parts = -(-sizes // capacity)
        doc = np.repeat(np.arange(len(n)), parts)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = piece * capacity
        length = np.minimum(capacity, sizes[doc] - start)
        first = (np.cumsum(sizes) - sizes)[doc] + start
        data = memoryview(out).cast("B")
        crc = [zlib.crc32(data[4 * a : 4 * z]) for a, z in zip(first.tolist(), (first + length).tolist(), strict=True)]
        order = np.argsort(length, kind="stable")
        runs = np.flatnonzero(np.diff(length[order], prepend=-1) != 0)
        rank = np.empty(len(doc), np.int64)
        rank[order] = np.arange(len(doc)) - np.repeat(runs, np.diff(np.append(runs, len(doc))))
        rank += seen[length]
        seen += np.bincount(length, minlength=capacity + 1)
        cols = [pa.array(np.full(len(doc), task, np.int32)), b["doc_id"].take(pa.array(lo + doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(rank)]
        yield pa.RecordBatch.from_arrays(cols, ["task", "doc_id", "piece", "start", "length", "ids_crc32", "rank"])
        pa.default_memory_pool().release_unused()


def sweep(runs: list[tuple[int, int, int, int]], capacity: int) -> list[tuple]:
    """runs (kind, size, start, n) of one range.  Rows of RUNS: the gaps and pieces that are left, and the matches."""
    lowest = min(size for _, size, _, _ in runs)
    todo = [(-size, kind, start, n) for kind, size, start, n in runs]
    heapq.heapify(todo)
    gaps: list[tuple[int, int, int]] = []  # those met so far, the smallest last
    out = []
    while todo:
        size, kind, start, n = heapq.heappop(todo)
        size = -size
        if kind == GAP:
            gaps.append((size, start, n))
            continue
        while n and gaps:
            gap, first, many = gaps.pop()
            each = min(n, gap // size)
            took = min(many, n // each)
            out.append((MATCH, size, start, took * each, first, each, capacity - gap))
            start, n = start + took * each, n - took * each
            if took < many:
                gaps.append((gap, first + took, many - took))
            left = gap - each * size
            if left >= lowest:  # found again, in this sweep, by what it holds
                heapq.heappush(todo, (-left, GAP, first, took))
            elif left:
                out.append((GAP, left, first, took, None, None, None))
            if left > size:  # only if fewer than fit were left, so n is 0
                gaps.sort(reverse=True)
        if n:
            out.append((PIECES, size, start, n, None, None, None))
    return out + [(GAP, *gap, None, None, None) for gap in gaps]


def _swept(batches: Iterator[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    ranges: dict[int, list[tuple[int, int, int, int]]] = {}
    for b in batches:
        for key, *run in zip(*(b[c].to_pylist() for c in ("range", "kind", "size", "start", "n")), strict=True):
            ranges.setdefault(key, []).append(tuple(run))
    names = [x.split()[0] for x in RUNS.split(", ")]
    types = [pa.int8(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    for _, runs in sorted(ranges.items()):
        cols = zip(*sweep(runs, capacity), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)


def match(counts: DataFrame, capacity: int = CAPACITY, ranges: int = RANGES) -> DataFrame:
    """counts (length, n).  (length, rank, n, first, each, offset): pieces rank .. rank + n - 1 of that length, `each`
    to a sequence, from sequence first and place offset on."""
    spark = counts.sparkSession
    runs = counts.select(F.lit(PIECES).cast("byte").alias("kind"), F.col("length").cast("int").alias("size"), F.lit(0).cast("long").alias("start"), F.col("n").cast("long").alias("n"))
    runs = runs.withColumns({"first": F.lit(None).cast("long"), "each": F.lit(None).cast("int"), "offset": F.lit(None).cast("int")})
    opened, matches = 0, []
    left = runs.agg(F.sum(F.col("size") * F.col("n")).alias("tokens")).first()["tokens"]
    while left:
        if not matches or ranges == 1:  # as many new sequences as what is left needs at least
            more = -(-left // capacity)
            runs = runs.unionByName(spark.range(1).select(F.lit(GAP).cast("byte").alias("kind"), F.lit(capacity).alias("size"), F.lit(opened).cast("long").alias("start"), F.lit(more).cast("long").alias("n")), allowMissingColumns=True)
            opened += more
        ranges = max(1, ranges // 2) if matches else ranges
        dealt = runs.withColumn("range", F.floor(F.col("size") * ranges / (capacity + 1)))
        found = staged(dealt.repartition(ranges, "range").mapInArrow(partial(_swept, capacity=capacity), RUNS), "sweep")
        matches.append(found.where(F.col("kind") == MATCH))
        runs = found.where(F.col("kind") != MATCH)
        left = runs.where(F.col("kind") == PIECES).agg(F.sum(F.col("size") * F.col("n")).alias("tokens")).first()["tokens"]
    matches = matches or [runs]
    for more in matches[1:]:
        matches[0] = matches[0].unionByName(more)
    return matches[0].select(F.col("size").alias("length"), F.col("start").alias("rank"), "n", "first", "each", "offset")


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end: int = END) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is the ids of its whole text and the id `end`; null and empty texts are just the end id.  Only
    documents longer than capacity are cut, into pieces of that length and a last one.  Repeated rows are packed as
    often as they come.  docs needs doc_id and text; other columns are ignored.  An empty table gives no row.
    """
    rows = docs.select("doc_id", text_of(docs).alias("text"))
    pieces = rows.mapInArrow(partial(_pieces, capacity=capacity, vocabulary=vocabulary, end=end), "task int, doc_id long, piece int, start long, length long, ids_crc32 long, rank long")
    pieces = staged(pieces, "pieces")
    counts = staged(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "counts")
    earlier = F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")
    # At most one row for each task, of at most `capacity` numbers; and one row for each length.
    shifts = counts.select("task", F.struct("length", earlier.alias("earlier")).alias("x")).groupBy("task").agg(F.map_from_entries(F.collect_list("x")).alias("earlier"))
    plan = match(counts.groupBy("length").agg(F.sum("n").alias("n")), capacity)
    plan = plan.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("rank", "n", "first", "each", "offset"))).alias("places"))
    ranked = pieces.join(staged(shifts, "shifts"), "task").withColumn("rank", F.col("rank") + F.element_at("earlier", F.col("length"))).drop("earlier", "task")
    place = F.filter("places", lambda x: (x["rank"] <= F.col("rank")) & (F.col("rank") < x["rank"] + x["n"]))[0]
    found = ranked.join(staged(plan, "plan").withColumn("length", F.col("length").cast("long")), "length").withColumn("place", place).withColumn("k", F.col("rank") - F.col("place.rank"))
    sequence = F.col("place.first") + F.floor(F.col("k") / F.col("place.each"))
    offset = F.col("place.offset") + F.pmod("k", F.col("place.each")) * F.col("length")
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
