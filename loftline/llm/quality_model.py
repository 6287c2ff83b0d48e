"""Quality classifier by nearest-neighbour voting in a latent-semantic space.

A document's terms are its words, its pairs of neighbouring bytes (spelling, case and marks), both hashed to a fixed number
of columns, and how long ago each word came last (long and short words apart).  Square roots of term shares, weighted
by inverse document frequency and less their mean, are projected on the first singular vectors of labelled documents (latent
semantic analysis: Deerwester et al., 1990).  The labelled vectors, at most SAMPLE of each label, are broadcast; every
document is compared with all of them in blocks, and the nearest ones vote by cosine.

Terms, axes and vectors are rounded to whole numbers before they are multiplied, so small that sums of products are exact
in double precision.  So a score depends on the text alone, not on the block that the text is in.
"""

from __future__ import annotations

from zlib import compress, crc32, decompress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of, unused
from .words import _folded, encoder, forget, slices

#: Labelled documents of each label that the model is fitted on: those with the smallest hash of their id.
SAMPLE = 2048
#: Latent dimensions, neighbours that vote, and the power of the cosine that weighs a vote.
DIMENSIONS, NEIGHBOURS, POWER = 24, 15, 8
#: Labelled documents that are weighed at once.
BLOCK = 512
#: Documents that are counted and compared at once, and bytes of text: what a worker holds beside its batch.  Neither changes a score.
FEW, BYTES = 64, 1 << 18
#: Columns for pairs of bytes and for words; gaps between occurrences of a word.
PAIRS, WORDS, GAPS = 1 << 12, 1 << 11, 5
COLUMNS = PAIRS + WORDS + 2 * GAPS
#: Whole numbers: units of a term's weight, of an axis, and of a vector of length one.
TERM, AXIS, VECTOR = 1 << 14, 1 << 14, 1 << 20


def _terms(texts: pa.Array) -> np.ndarray:
    """One row of term weights for each text, in units of TERM; zeros for a text without words."""
    if encoder.cache_info().currsize:
        forget()
    out = np.zeros((len(texts), COLUMNS), np.int16)
    for i in range(0, len(texts), FEW):
        for lo, part in slices(pc.fill_null(texts.slice(i, FEW), "").cast(pa.large_string()), BYTES):
            _count(part, out[i + lo : i + lo + len(part)])
    return out


def _count(texts: pa.Array, out: np.ndarray) -> None:
    """Fills out, a row for each text."""
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    ends, pairs = offsets[1:] - offsets[0], np.zeros(n * PAIRS, np.int64)
    for a in range(0, len(data) - 1, BYTES):  # of a long text too, a stretch at a time
        some = data[a : a + BYTES + 1].astype(np.int64)
        doc = np.searchsorted(ends, np.arange(a, a + len(some)), side="right")
        pair = ((some[:-1] << 8 | some[1:]) * 40503 >> 4) % PAIRS
        pairs += np.bincount((doc[1:] * PAIRS + pair)[doc[1:] == doc[:-1]], minlength=n * PAIRS)
    out[:, :PAIRS] = _shares(pairs, n)
    cut = pc.split_pattern(_folded(texts), " ")
    many = np.diff(np.asarray(cut.offsets))
    first = int(np.asarray(cut.offsets)[0])
    coded = cut.values.slice(first, int(many.sum())).dictionary_encode()
    size = np.asarray(pc.binary_length(coded.dictionary))
    column = np.array([crc32(x.as_buffer()) % WORDS for x in coded.dictionary], np.int64)
    code, doc = np.asarray(coded.indices), np.repeat(np.arange(n), many)
    word = size[code] > 0 if len(code) else np.zeros(0, bool)
    code, doc = code[word].astype(np.int64), doc[word]
    out[:, PAIRS : PAIRS + WORDS] = _shares(np.bincount(doc * WORDS + column[code] if len(code) else code, minlength=n * WORDS), n)
    key = doc * max(1, len(size)) + code
    order = np.argsort(key, kind="stable")
    gap = np.diff(order, prepend=0)
    gap[np.diff(key[order], prepend=-1) != 0] = 0
    gap = np.searchsorted([1, 2, 9, 65], gap, side="right") + GAPS * (size[code[order]] >= 6)
    out[:, PAIRS + WORDS :] = _shares(np.bincount(doc[order] * 2 * GAPS + gap, minlength=n * 2 * GAPS), n)


def _shares(counts: np.ndarray, rows: int) -> np.ndarray:
    """Of the counts of cells, row by row: square roots of their shares in the row, in units of TERM."""
    counts = counts.reshape(rows, -1)
    return np.rint(TERM * np.sqrt(counts / np.maximum(1, counts.sum(1, keepdims=True)))).astype(np.int16)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, in units of VECTOR; each row by itself, so its block doesn't matter."""
    length = np.sqrt(np.array([sum(v * v for v in row) for row in x.tolist()]).reshape(-1, 1))
    return np.rint(x * (VECTOR / np.maximum(1e-12, length)))


class Model:
    """At most 2 * SAMPLE labelled vectors and one projection: bounded, whatever the corpus."""

    def __init__(self, terms: np.ndarray, labels: np.ndarray, share: float):
        """share: of label 1 among all labelled rows."""
        self.share, self.labels = share, labels.astype(np.float64)
        # A term that few documents have tells more.
        rare = np.log((1 + len(terms)) / (1 + np.count_nonzero(terms, axis=0))) + 1
        axes = self._axes(terms, rare / TERM) * rare[:, None]
        self.axes = np.rint(axes * (AXIS / max(1e-12, np.abs(axes).max(initial=0))))
        self.centre = np.rint(terms.mean(0, dtype=np.float64) @ self.axes) if len(terms) else np.zeros(self.axes.shape[1])
        self.vectors = np.concatenate([_unit(self._points(terms[i : i + BLOCK])) for i in range(0, len(terms), BLOCK)] or [np.zeros((0, self.axes.shape[1]))])
        good = labels.mean() if len(labels) else 0.5
        # Each label stands for its share of all labelled rows, whatever the sample holds of it.
        self.weights = np.where(labels == 1, share / max(good, 1e-12), (1 - share) / max(1 - good, 1e-12))

    @staticmethod
    def _axes(terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """First right singular vectors of the weighed terms less their mean, by subspace iteration from a fixed start.

        The terms stay as they are: a block of them is weighed at a time, so the driver holds little else.
        """
        found = np.random.default_rng(0).standard_normal((len(weights), DIMENSIONS + 16))
        mean = terms.mean(0, dtype=np.float64) * weights if len(terms) else np.zeros(len(weights))
        for _ in range(8):
            found = np.linalg.qr(found)[0]
            onto = np.zeros_like(found)
            for i in range(0, len(terms), BLOCK):
                part = terms[i : i + BLOCK] * weights - mean
                onto += part.T @ (part @ found)
            _, turn = np.linalg.eigh(found.T @ onto)
            found, onto = found @ turn[:, ::-1], onto @ turn[:, ::-1]
            axes, found = found, onto
        return axes[:, :DIMENSIONS]

    def _points(self, terms: np.ndarray) -> np.ndarray:
        return terms.astype(np.float64) @ self.axes - self.centre

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = np.full(len(texts), self.share)
        if not len(self.labels):
            return out
        k = min(NEIGHBOURS, len(self.labels))
        for i in range(0, len(texts), FEW):
            cosine = _unit(self._points(_terms(texts.slice(i, FEW)))) @ self.vectors.T
            # Of equally near neighbours the first counts.
            order = cosine * len(self.labels) - np.arange(len(self.labels))
            near = np.sort(np.argpartition(-order, k - 1, axis=1)[:, :k], axis=1)
            vote = np.maximum(0, np.take_along_axis(cosine, near, 1) / VECTOR**2) ** POWER * self.weights[near]
            total, won = (np.array([sum(row) for row in x.tolist()]) for x in (vote, vote * self.labels[near]))
            out[i : i + FEW] = np.where(total > 0, won / np.maximum(total, 1e-300), self.share)
        pa.default_memory_pool().release_unused()  # a worker that waits for later stages keeps little
        return np.clip(out, 0, 1)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(3)) == 1


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """From the labelled documents whose crc32(doc_id) mod 3 is not 1; a fixed, documented number of them."""
    marked = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    marked = marked.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    counts = {r["quality"]: r["n"] for r in marked.groupBy("quality").agg(F.count("*").alias("n")).where("quality IN (0, 1)").collect()}
    total = sum(counts.values())
    parts = [marked.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for q in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # 2 * SAMPLE rows at most
    rows = docs.select("doc_id", text_of(docs).alias("text")).join(chosen, "doc_id").select("doc_id", "quality", "text")
    dtype = "doc_id long, quality int, terms binary"

    def weighed(batches):
        for b in batches:
            for i in range(0, b.num_rows, BLOCK):
                part = b.slice(i, BLOCK)
                terms = [compress(x.tobytes(), 1) for x in _terms(part["text"])]
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["quality"].cast(pa.int32()), pa.array(terms, pa.binary())], ["doc_id", "quality", "terms"])

    found = rows.mapInArrow(weighed, dtype).groupBy("doc_id", "quality").agg(F.min("terms").alias("terms")).toPandas().sort_values("doc_id")
    terms = np.zeros((len(found), COLUMNS), np.int16)
    for k, x in enumerate(found["terms"]):
        terms[k] = np.frombuffer(decompress(x), np.int16)
    return Model(terms, found["quality"].to_numpy(), counts.get(1, 0) / total if total else 0.5)


def score(docs: DataFrame, model: Model) -> Column:
    """For whole texts: 0 to 1, higher if label 1 is likelier.  Null and empty texts have a score like any other."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def voted(texts: pa.Array) -> pa.Array:
        return pa.array(sent.value.scores(texts))

    return voted(text_of(docs))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted.

    Only the text is an input.  Labels of unknown documents and null labels are ignored; of repeated labels the
    highest counts.  Without labels each score is 0.5.  Texts without words have the score of their place in the
    latent space.  Equal texts have equal scores; repeated rows are repeated.  Other columns are ignored.  An empty
    table gives no row.
    """
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(docs, fit(docs, labels)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_low_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs with a score of at least 0.5, with all their columns, whatever these are called.

    A row stays or goes by its text alone: nulls count as empty, equal texts share a fate, repeated rows are repeated, ids
    may be null.  Without labels all rows stay.  An empty table gives no row.
    """
    name = unused(docs, "_score")
    return docs.withColumn(name, score(docs, fit(docs, labels))).where(F.col(name) >= 0.5).drop(name)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
