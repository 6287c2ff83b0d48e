"""Texts whose sets of five-word shingles have a Jaccard similarity of `similarity` or more.

Candidates share a band of MinHash values (Broder, 1997): with BANDS bands of ROWS values a pair at 0.8 is missed with
probability (1 - 0.8^5)^40, about 1e-7.  Bands in which only one component meets have nothing to add.  Texts that the other
bands connect are a family.  A family is cut into parts of bounded size, each two parts meet in one task, and the task
compares whole shingle sets and emits only links that span what it has found, never pairs.  Most families have one
part.  In a family of m texts a text is sent m / TEXTS times, which is the price of leaving out no pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged, text_of
from .components import connected_components
from .words import _ranges

WINDOW, ROWS, BANDS = 5, 5, 40
#: Texts and shingles of a family's part, about.
TEXTS, SHINGLES = 512, 1 << 20
_RANDOM = np.random.default_rng(42)
_TIMES = _RANDOM.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_PLUS = _RANDOM.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64) << np.uint64(1)


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the five-word windows, A-Z lower-cased; of all words if they are fewer."""
    words = text.lower().split()  # of bytes: ASCII letters and ASCII white space only
    windows = map(b" ".join, zip(*(words[i:] for i in range(WINDOW)), strict=False)) if len(words) >= WINDOW else [b" ".join(words)] * bool(words)
    return np.unique(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), windows), np.uint64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """A hash of each band of MinHash values; none for no shingle."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[i : i + 1024, None] * _TIMES + _PLUS).min(0), out=least)
    parts = least.reshape(BANDS, ROWS).astype("<u8")
    return np.array([xxhash.xxh64_intdigest(p.tobytes(), seed=k) for k, p in enumerate(parts)], np.uint64).view(np.int64)


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)])
    flat = np.concatenate([np.zeros(0, np.int64), *(v.view(np.int64) for v in values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def _made(batches: Iterator[pa.RecordBatch], what: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, 1024):
            part = b.slice(i, 1024)
            sets = [shingles(x.as_buffer().to_pybytes()) for x in part["text"].cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([part["sha"], _lists([bands(s) for s in sets] if what == "bands" else sets)], ["sha", what])


def local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0..n-1 with edges a-b: the smallest node that each reaches."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _spanning(left: list, right: list, similarity: float) -> np.ndarray:
    """left, right: (root, shingles) of two parts.  Rows (root, root) that connect what links between similar texts connect."""
    roots, sizes = np.array([r for r, _ in left]), np.array([len(s) for _, s in left])
    flat, owner = np.concatenate([s for _, s in left]), np.repeat(np.arange(len(left)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    found = [np.zeros((0, 2), np.int64)]
    for root, mine in right:
        lo = np.searchsorted(flat, mine)
        shared = np.bincount(owner[_ranges(lo, np.searchsorted(flat, mine, side="right") - lo)], minlength=len(left))
        near = (shared >= similarity * (sizes + len(mine) - shared) - 1e-9) & (roots != root)
        found.append(np.stack([roots[near], np.full(near.sum(), root)], 1))
    pairs = np.unique(np.concatenate(found), axis=0)
    nodes, at = np.unique(pairs, return_inverse=True)
    least = local_roots(*at.reshape(-1, 2).T, len(nodes)) if len(pairs) else np.zeros(0, np.int64)
    keep = least != np.arange(len(nodes))
    return np.stack([nodes[least[keep]], nodes[keep]], 1)


def _compared(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by family, lo, hi: the parts lo and hi of the family, which are held."""
    key, parts = None, {}

    def out() -> Iterator[pa.RecordBatch]:
        if len(pairs := _spanning(parts.get(key[1], []), parts.get(key[2], []), similarity) if all(k in parts for k in key[1:]) else []):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

    for b in batches:
        for family, lo, hi, part, root, x in zip(*(b[c].to_pylist() for c in ("family", "lo", "hi", "part", "root")), b["shingles"], strict=True):
            if (family, lo, hi) != key:
                if key:
                    yield from out()
                key, parts = (family, lo, hi), {}
            parts.setdefault(part, []).append((root, np.asarray(x.values).view(np.uint64)))
    if key:
        yield from out()


def similar_roots(docs: DataFrame, nodes: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """docs needs text; nodes (sha, fp): SHA-256 and node of each text; roots (node, root): components known so far.

    Returns (node, root) with the links of similar texts added.  Texts without words link to none.  Each text has a number
    of its own, so no two texts can be taken for one.
    """
    text = text_of(docs).alias("text")
    texts = docs.select(F.unhex(F.sha2(text_of(docs), 256)).alias("sha"), text)
    known = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("sha", F.coalesce("root", "fp").alias("root"))
    known = staged(known.withColumn("tid", F.monotonically_increasing_id()), "texts")
    made = texts.mapInArrow(partial(_made, what="bands"), "sha binary, bands array<long>").dropDuplicates(["sha"])
    rows = staged(made.join(known, "sha").select("tid", "root", F.explode("bands").alias("band")), "bands")
    ends = rows.groupBy("band").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.min("tid").alias("leader")).where("least <> most")
    mixed = staged(rows.join(ends, "band").select("tid", "root", "leader").distinct(), "mixed")
    discard(rows)
    families = connected_components(mixed.select(F.col("tid").alias("a"), F.col("leader").alias("b")))
    member = mixed.select("tid", "root").distinct()
    families = families.select(F.col("node").alias("tid"), F.col("root").alias("family"))
    member = member.join(families, "tid", "left").withColumn("family", F.coalesce("family", "tid"))
    member = staged(member.join(known.select("tid", "sha"), "tid"), "member")
    sets = texts.join(member.select("sha"), "sha", "left_semi").mapInArrow(partial(_made, what="shingles"), "sha binary, shingles array<long>").dropDuplicates(["sha"])
    sets = staged(sets.join(member, "sha").drop("sha"), "shingles")
    parts = F.ceil(F.greatest(F.count("*") / TEXTS, F.sum(F.size("shingles")) / SHINGLES)).cast("int")
    sizes = sets.groupBy("family").agg(parts.alias("parts"))
    rows = sets.join(sizes, "family").withColumn("part", F.pmod(F.xxhash64("tid"), "parts").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("family", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "root", "shingles")
    rows = rows.repartition("family", "lo", "hi").sortWithinPartitions("family", "lo", "hi")
    found = staged(rows.mapInArrow(partial(_compared, similarity=similarity), "a long, b long").distinct(), "similar")
    discard(mixed, member, known, sets)
    if found.isEmpty():
        return roots
    return connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found))
