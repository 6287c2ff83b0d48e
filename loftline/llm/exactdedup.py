"""Exact duplicates by counting quotient filters (Pandey et al., 2017).

A text's fingerprint has q quotient bits and 16 remainder bits, q following the number of rows.  Each partition counts
its fingerprints and writes them as counting quotient filters, one for each range of quotients that it meets: the
occupied quotients, a bit for each slot that ends a run, the sorted remainders, and counters for the repeated ones.
Occupied quotients are a bit each where they are dense, and steps from one to the next where they are sparse, so a
fingerprint takes about as many bytes however many rows the table has.  Filters of a range merge by their sorted
remainders and lose nothing, whatever the order; a task holds one range at a time and merges it as filters come.  A fingerprint
counted once is a text without copies.  The others are routed to byte verification: whole normalised texts are grouped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS, kept_rows, same, staged, table, text_of

WHITE = bytes([9, 10, 11, 12, 13, 32])
REMAINDER = 16
#: Fingerprints in a merged filter, about.
RANGE = 1 << 17
#: Bytes of a range's filters that a task holds before it merges them.
HELD = 1 << 24


def _signatures(batches: Iterator[pa.RecordBatch], bits: int, body: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in b["text"].cast(pa.large_binary())]
        norm = [x.translate(None, WHITE) for x in texts]
        points = pa.array([len(x.decode("utf-8", "replace")) for x in texts], pa.int64())
        prints = pa.array([xxhash.xxh64_intdigest(x) >> (64 - bits) for x in norm], pa.int64())
        sha = pa.array([hashlib.sha256(x).hexdigest() for x in norm], pa.string())
        cols = [b["doc_id"], points, prints, sha] + ([pa.array(norm, pa.binary())] if body else [])
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "points", "fp", "sha", "norm"][: len(cols)])


def signatures(docs: DataFrame, bits: int, body: bool = False) -> DataFrame:
    """(doc_id, points, fp, sha[, norm]) of whole texts, the norm being the text without white space."""
    rows = docs.select("doc_id", text_of(docs).alias("text"))
    return rows.mapInArrow(partial(_signatures, bits=bits, body=body), "doc_id long, points long, fp long, sha string" + ", norm binary" * body)


def pack_filter(prints: np.ndarray, counts: np.ndarray, base: int, quotients: int) -> bytes:
    """A counting quotient filter of sorted, distinct fingerprints whose quotients lie in base .. base + quotients - 1."""
    quotient = (prints >> REMAINDER) - base
    ends = np.append(np.diff(quotient) != 0, True)
    runs = quotient[ends]
    sparse = 4 * len(runs) < -(-quotients // 8)
    if sparse:
        occupied = np.diff(runs, prepend=0).astype("<u4")
    else:
        occupied = np.zeros(quotients, np.uint8)
        occupied[runs] = 1
        occupied = np.packbits(occupied)
    several = counts > 1
    head = np.array([len(prints), several.sum(), len(runs) if sparse else 0], "<u4").tobytes()
    parts = [occupied, np.packbits(ends), np.packbits(several), (prints & ((1 << REMAINDER) - 1)).astype("<u2"), counts[several].astype("<u8")]
    return head + b"".join(x.tobytes() for x in parts)


def unpack_filter(data: bytes, base: int, quotients: int) -> tuple[np.ndarray, np.ndarray]:
    """The filter's fingerprints, sorted, and their counts."""
    n, m, runs = (int(x) for x in np.frombuffer(data, "<u4", 3))
    at = np.cumsum([12, 4 * runs or -(-quotients // 8), -(-n // 8), -(-n // 8), 2 * n, 8 * m])
    if runs:
        occupied = np.cumsum(np.frombuffer(data, "<u4", runs, 12).astype(np.int64))
    else:
        occupied = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, at[1] - 12, 12), count=quotients))
    ends, several = (np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8), at[i]), count=n) for i in (1, 2))
    quotient = occupied[np.cumsum(ends) - ends] + base
    counts = np.ones(n, np.int64)
    counts[several.astype(bool)] = np.frombuffer(data, "<u8", m, at[4])
    return quotient << REMAINDER | np.frombuffer(data, "<u2", n, at[3]), counts


def merge_filters(filters: list[bytes], base: int, quotients: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted runs are merged; counts of one fingerprint add up."""
    both = [unpack_filter(x, base, quotients) for x in filters]
    prints, counts = (np.concatenate(x) for x in zip(*both, strict=True))
    return _summed(prints, counts)


def _filters(batches: Iterator[pa.RecordBatch], quotients: int) -> Iterator[pa.RecordBatch]:
    def write(prints: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        ranges = (prints >> REMAINDER) // quotients
        cuts = [0, *(np.flatnonzero(np.diff(ranges)) + 1), len(prints)]
        for i in range(0, len(cuts) - 1, 4096):
            spans = list(zip(cuts[i : i + 4096], cuts[i + 1 : i + 4097], strict=False))
            at = [int(ranges[lo]) for lo, _ in spans]
            packed = [pack_filter(prints[lo:hi], counts[lo:hi], r * quotients, quotients) for r, (lo, hi) in zip(at, spans, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(packed, pa.binary())], ["range", "filter"])

    prints, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for b in batches:
        new, n = np.unique(b["fp"].to_numpy(zero_copy_only=False), return_counts=True)
        prints, counts = np.concatenate([prints, new]), np.concatenate([counts, n])
        if len(prints) > 1 << 22:
            yield from write(*_summed(prints, counts))
            prints, counts = prints[:0], counts[:0]
    if len(prints):
        yield from write(*_summed(prints, counts))


def _summed(prints: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(prints, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(prints[order]) != 0))
    return prints[order][first], np.add.reduceat(counts[order], first)


def fingerprint_bits(rows: int) -> int:
    """Quotient bits for a load of a half to one quarter, and 16 remainder bits."""
    return min(60, max(8, (2 * rows - 1).bit_length()) + REMAINDER)


def repeated(prints: DataFrame, bits: int, held: int = HELD) -> DataFrame:
    """prints (fp).  The fingerprints of `bits` bits that two rows or more have."""
    quotients = min(2 * RANGE, 1 << (bits - REMAINDER))
    filters = prints.select("fp").mapInArrow(partial(_filters, quotients=quotients), "range long, filter binary")
    return filters.repartition("range").sortWithinPartitions("range").mapInArrow(partial(_merged, quotients=quotients, held_bytes=held), "fp long")


def _merged(batches: Iterator[pa.RecordBatch], quotients: int, held_bytes: int) -> Iterator[pa.RecordBatch]:
    """Filters come sorted by range.  The fingerprints that count more than once."""
    at, held, size = None, [], 0

    def found() -> pa.RecordBatch:
        prints, counts = merge_filters(held, at * quotients, quotients)
        return pa.RecordBatch.from_arrays([pa.array(prints[counts > 1])], ["fp"])

    for b in batches:
        for r, x in zip(b["range"].to_pylist(), b["filter"], strict=True):
            if r != at and held:
                yield found()
                held, size = [], 0
            at = r
            held.append(x.as_buffer())
            size += x.as_buffer().size
            if size > held_bytes:  # one filter instead of many: no more than a range holds
                held = [pack_filter(*merge_filters(held, at * quotients, quotients), at * quotients, quotients)]
                size = 0
    if held:
        yield found()


def exact_duplicates(docs: DataFrame, bits: int | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical without white space; null is empty; empty texts are equal to each other.  Of equal
    texts the row with the most code points stays, then the smallest doc_id (a null id comes last).  Rows that repeat
    one doc_id and text each count in group_size and get the same answer.  docs needs doc_id and text; other columns
    are ignored.  An empty table gives no row.  SHA-256 stands for a class once its bytes are verified; a collision
    between two different texts raises an error.
    """
    bits = bits or fingerprint_bits(docs.count())
    signed = staged(signatures(docs, bits), "signed")
    suspects = signed.join(repeated(signed, bits), "fp", "left_semi").select("doc_id").distinct()
    bodies = docs.join(suspects, same(docs, suspects, "doc_id"), "left_semi")
    best = F.min(F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("n"), "doc_id"))
    classes = signatures(bodies, bits, body=True).groupBy("norm").agg(best.alias("best"), F.count("*").alias("size"), F.first("sha").alias("sha"))
    classes = classes.where("size > 1").select("sha", F.col("best.doc_id").alias("keep"), "size")
    clash = F.raise_error(F.lit("two texts have one SHA-256"))
    classes = classes.groupBy("sha").agg(F.when(F.count("*") > 1, clash.cast("long")).otherwise(F.first("keep")).alias("keep"), F.first("size").alias("size"))
    found = signed.join(classes, "sha", "left")
    keep = F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("keep"))
    return found.select("doc_id", keep.alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, one for each distinct text, with all their columns, whatever these are called.

    See exact_duplicates() for nulls and ties.  Of rows that share an id and a text one stays; ids may be null or shared by
    different texts.  An empty table gives no row.
    """
    found = exact_duplicates(docs).select("doc_id", F.col("text_sha256").alias("digest"), "kept")
    return kept_rows(docs, found, F.sha2(F.regexp_replace(text_of(docs), WS + "+", ""), 256))


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents),
     g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
                  count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
