"""SimHash near-duplicates, found by anchor-point covering.

Anchors are the words of a covering code: the 64 bits are cut into blocks of 23, 23, 15 and 3 bits, and each block
has a perfect code (binary Golay, radius 3, twice; Hamming, radius 1, twice).  A fingerprint's home is its nearest
word in each block.  If two fingerprints differ in at most t bits, of which t_b fall into block b, then the one is
within R_b + t_b of the other's home in each block.  So a fingerprint goes to its home and is replicated to every
anchor within covering radius plus threshold, the threshold being shared by the blocks: sum of max(0, d_b - R_b) <= t.
Each anchor compares its homes with its replicas; no pair is missed and none is compared twice in the same direction.

How many blocks are used depends on the number of distinct fingerprints only, so that an anchor holds few of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept_rows, staged, table, text_of
from .components import connected_components
from .similar import local_roots, similar_roots

#: Length, radius and generator polynomial of the perfect codes (Golay 1949, Hamming 1950).
BLOCKS = ((23, 3, 0b101011100011), (23, 3, 0b101011100011), (15, 1, 0b10011), (3, 1, 0b111))
#: Up to so many distinct fingerprints, that many blocks make up the anchors.
DEPTHS = ((1 << 23, 1), (1 << 35, 2), (1 << 62, 4))
#: An anchor with more homes than this is split, and its replicas are sent to each part.
HOMES = 1 << 14
#: Cells that a task compares at once.
CELLS = 1 << 22


def fingerprint(text: bytes, width: int = 3) -> int:
    """Of the shingles of a whole UTF-8 text, A-Z lower-cased; 0 if it has no word."""
    words = text.lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8)
        ones += np.unpackbits(part, bitorder="little").reshape(-1, 64).sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = np.array([fingerprint(x.as_buffer().to_pybytes(), width) if x.is_valid else 0 for x in b["text"].cast(pa.large_binary())], np.uint64)
        names = [n for n in b.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(b[n] for n in names), pa.array(prints.view(np.int64))], [*names, "fp"])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the 64-bit fingerprint as a signed long.  One row for each row; null text is empty."""
    return docs.select("doc_id", text_of(docs).alias("text")).mapInArrow(partial(_fingerprints, width=width), "doc_id long, fp long")


@cache
def _block(k: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For block k: syndrome of each byte-sized part, and by syndrome the error words that cost at most `most`."""
    n, radius, poly = BLOCKS[k]
    degree = poly.bit_length() - 1

    def syndrome(x: np.ndarray) -> np.ndarray:
        x = x.astype(np.int64)
        for bit in range(n - 1, degree - 1, -1):
            x = np.where(x >> bit & 1, x ^ (poly << (bit - degree)), x)
        return x

    words = np.array([sum(1 << i for i in c) for w in range(min(n, radius + most) + 1) for c in combinations(range(n), w)], np.int64)
    cost = np.maximum(0, np.bitwise_count(words).astype(np.int64) - radius)
    of = syndrome(words)
    order = np.lexsort((cost, of))
    starts = np.searchsorted(of[order], np.arange((1 << degree) + 1))
    return syndrome(np.arange(1 << n) if n < 16 else np.arange(1 << 12)), words[order], cost[order], starts


def _syndromes(k: int, bits: np.ndarray, low: np.ndarray) -> np.ndarray:
    n, _, poly = BLOCKS[k]
    if n < 16:
        return low[bits]
    degree, x = poly.bit_length() - 1, bits.astype(np.int64)
    for bit in range(n - 1, degree - 1, -1):
        x = np.where(x >> bit & 1, x ^ (poly << (bit - degree)), x)
    return x


def anchors(fps: np.ndarray, threshold: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each fingerprint (uint64): index into fps, anchor (int64) and whether that is its home."""
    index, anchor = np.arange(len(fps)), np.zeros(len(fps), np.int64)
    spent, home, shift = np.zeros(len(fps), np.int64), np.ones(len(fps), bool), 0
    for k in range(depth):
        n = BLOCKS[k][0]
        low, words, cost, starts = _block(k, threshold)
        bits = (fps[index] >> np.uint64(shift) & np.uint64((1 << n) - 1)).astype(np.int64)
        of = _syndromes(k, bits, low)
        many = starts[of + 1] - starts[of]
        to = np.repeat(np.arange(len(index)), many)
        e = np.arange(len(to)) - np.repeat(np.cumsum(many) - many, many) + starts[of][to]
        total = spent[to] + cost[e]
        keep = total <= threshold
        to, e, total = to[keep], e[keep], total[keep]
        anchor = anchor[to] * 1_000_003 ^ (bits[to] ^ words[e]) if depth > 2 else anchor[to] << n | (bits[to] ^ words[e])
        index, spent, home, shift = index[to], total, home[to] & (cost[e] == 0), shift + n
    return index, anchor, home


def _replicas(batches: Iterator[pa.RecordBatch], threshold: int, depth: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = b["fp"].to_numpy(zero_copy_only=False).view(np.uint64)
        for i in range(0, len(fps), 4096):
            index, anchor, home = anchors(part := fps[i : i + 4096], threshold, depth)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array((~home).astype(np.int8)), pa.array(part[index].view(np.int64))], ["anchor", "replica", "fp"])


def _links(homes: np.ndarray, replicas: np.ndarray, threshold: int) -> np.ndarray:
    """Pairs (smaller fingerprint as root, other) that span what the two sides' links connect: no more than nodes."""
    spans = np.zeros((0, 2), np.uint64)
    step = max(1, CELLS // max(1, len(homes)))
    for i in range(0, len(replicas), step):
        part = replicas[i : i + step]
        r, h = np.nonzero(np.bitwise_count(part[:, None] ^ homes[None, :]) <= threshold)
        x, y = part[r], homes[h]
        x, y = x[x != y], y[x != y]
        if len(x):
            x, y = np.concatenate([x, spans[:, 0]]), np.concatenate([y, spans[:, 1]])
            nodes, at = np.unique(np.concatenate([x, y]), return_inverse=True)
            roots = local_roots(at[: len(x)], at[len(x) :], len(nodes))
            keep = roots != np.arange(len(nodes))
            spans = np.stack([nodes[roots[keep]], nodes[keep]], 1)
    return spans


def _compared(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor, salt and replica.  An anchor's homes are held; its replicas stream past."""
    key, homes = None, np.zeros(0, np.uint64)
    for b in batches:
        cols = [b[c].to_numpy(zero_copy_only=False) for c in ("anchor", "salt", "replica", "fp")]
        if not len(cols[0]):
            continue
        cuts = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0)) + 1
        out = []
        for lo, hi in zip([0, *cuts], [*cuts, len(cols[0])], strict=True):
            at, fps = (cols[0][lo], cols[1][lo]), cols[3][lo:hi].view(np.uint64)
            if at != key:
                key, homes = at, np.zeros(0, np.uint64)
            if not cols[2][lo]:
                homes = np.concatenate([homes, fps])
            elif len(homes):
                out.append(_links(homes, fps, threshold))
            if not cols[2][lo] and len(homes) > 1:
                out.append(_links(homes, fps, threshold))
        if pairs := [x for x in out if len(x)]:
            pairs = np.concatenate(pairs).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])


def links(prints: DataFrame, threshold: int = 3) -> DataFrame:
    """prints (fp), distinct.  (a, b): links that connect just the fingerprints that links of <= threshold bits connect."""
    depth = next(d for most, d in DEPTHS if prints.count() <= most)
    rows = prints.select("fp").mapInArrow(partial(_replicas, threshold=threshold, depth=depth), "anchor long, replica byte, fp long")
    homes = prints.select("fp").mapInArrow(partial(_replicas, threshold=0, depth=depth), "anchor long, replica byte, fp long").where("replica = 0")
    hot = homes.groupBy("anchor").count().where(F.col("count") > HOMES).select("anchor", F.ceil(F.col("count") / HOMES).cast("int").alias("parts"))
    hot = staged(hot, "hot")
    rows = rows.join(hot, "anchor", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    salts = F.when(F.col("replica") == 1, F.sequence(F.lit(0), F.col("parts") - 1))
    # A home is compared in its own part, and is a replica for the parts beside it.
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    rows = rows.select("anchor", "fp", "replica", own.alias("own"), F.explode(F.coalesce(salts, F.sequence(F.lit(0), F.col("parts") - 1))).alias("salt"))
    rows = rows.select("anchor", "salt", F.when((F.col("replica") == 0) & (F.col("salt") == F.col("own")), 0).otherwise(1).cast("byte").alias("replica"), "fp")
    rows = rows.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "replica")
    return rows.mapInArrow(partial(_compared, threshold=threshold), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = 3, threshold: int = 3, similarity: float | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable), kept.

    docs needs doc_id and text; other columns are ignored.  A null or empty text has fingerprint zero and links like
    any other.  Rows with one text have one fingerprint; repeated rows give repeated rows.  A null doc_id stays null
    and is never the smallest unless its component has no other.  kept marks the rows with the component's smallest
    doc_id (if texts share that id, those with the smallest fingerprint).  An empty table gives no row.  With a
    similarity, texts whose five-word shingles have that Jaccard similarity link too, however many bits differ.
    """
    if similarity is None:
        prints = staged(fingerprints(docs, width), "prints")
    else:
        text = text_of(docs).alias("text")
        digest = F.unhex(F.sha2(text_of(docs), 256)).alias("sha")
        prints = docs.select("doc_id", digest, text).mapInArrow(partial(_fingerprints, width=width), "doc_id long, sha binary, fp long")
        prints = staged(prints, "prints")
    distinct = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = connected_components(links(distinct, threshold))
    if similarity is not None:
        roots = similar_roots(docs, prints.select("sha", "fp").distinct(), roots, similarity)
    member = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    first = F.struct(F.col("first_id").isNull().alias("n"), F.col("first_id").alias("id"), F.col("fp").alias("keep_fp"))
    least = member.groupBy("root").agg(F.min(first).alias("least")).select("root", F.col("least.id").alias("component_id"), F.col("least.keep_fp").alias("keep_fp"))
    member = member.join(least, "root").select("fp", "component_id", (F.col("fp") == F.col("keep_fp")).alias("first"))
    kept = F.col("first") & F.col("doc_id").eqNullSafe(F.col("component_id"))
    return prints.join(member, "fp").select("doc_id", _hex(F.col("fp")).alias("fingerprint"), "component_id", kept.alias("kept"))


def _hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_duplicates(docs: DataFrame, width: int = 3, threshold: int = 3, similarity: float | None = None) -> DataFrame:
    """The rows of docs that stay: one of each component, that with the smallest doc_id, with all its columns.

    See near_duplicates() for nulls and ties.  Of rows that share an id and a text one stays.  An empty table gives no row.
    """

    @F.arrow_udf("long")
    def printed(texts: pa.Array) -> pa.Array:
        return next(_fingerprints([pa.RecordBatch.from_arrays([texts, texts], ["doc_id", "text"])], width))["fp"]

    found = near_duplicates(docs, width, threshold, similarity).withColumnRenamed("fingerprint", "digest")
    return kept_rows(docs, found, _hex(printed(text_of(docs))))


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
