"""Toxicity by multiple-instance learning: only documents have labels, and sentences are scored.

A sentence's evidence is the set of its words' beginnings (PREFIXES letters, and whole words), of which those that
labelled toxic documents have more often are kept.  A sentence without evidence can't offend; another offends with the
logistic of its weights' sum.  A document is toxic if any of its sentences offends, or by a leak that no sentence
explains: noisy-or (Pearl, 1988).  Weights are fitted to the documents' labels through that noisy-or, so a toxic document
credits those of its sentences that explain it, and they are located by their own scores afterwards.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table, text_of

#: Labelled documents of each label that the model is fitted on (those with the smallest hash of their id), and the
#: longest of them in bytes: what the driver holds of them is bounded by both.
SAMPLE, LONGEST = 4096, 1 << 20
#: Letters of a beginning, least and most; a whole word counts as one more.
PREFIXES = (3, 8)
#: Beginnings that are kept: at most so many, in so many toxic documents of the sample at least, with a log-likelihood
#: ratio of at least so much.
FEATURES, LEAST, RATIO = 1024, 3, 15.0
#: Steps of the fit, the length of the first one, and the price of a squared weight.
STEPS, RATE, PRICE = 600, 0.3, 2e-6
THRESHOLD = 0.7
#: Words that a Python worker remembers.
REMEMBERED = 400_000

SENTENCE = re.compile(r"[^.!?\n…。]+")
LETTERS = re.compile(r"[^\W\d_]+")


def beginnings(word: str) -> list[str]:
    """What a word, in lower case, may be known by: the word itself, and its beginnings."""
    lo, hi = PREFIXES
    return [f"{word}$", *(word[:n] for n in range(lo, min(hi, len(word)) + 1))]


class Evidence:
    """Numbers of the kept beginnings in words, sentences and texts."""

    def __init__(self, features: list[str]):
        self.of = {f: i for i, f in enumerate(features)}
        self.known: dict[str, tuple[int, ...]] = {}

    def word(self, word: str) -> tuple[int, ...]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = self.known[word] = tuple(i for f in beginnings(word) if (i := self.of.get(f)) is not None)
        return found

    def sentences(self, text: str) -> Iterator[tuple[int, int, list[int]]]:
        """Start, end and evidence of each sentence that has any, in code points of the text."""
        known, word = self.known, self.word
        for s in SENTENCE.finditer(text):
            seen: set[int] = set()
            for w in LETTERS.findall(s.group().lower()):
                x = known.get(w)
                if x is None:
                    x = word(w)
                if x:
                    seen.update(x)
            if seen:
                yield s.start(), s.end(), sorted(seen)


class Model:
    """Kept beginnings, their weights, what every sentence with evidence starts from, and the leak."""

    def __init__(self, features: list[str], weights: np.ndarray, start: float, leak: float):
        self.evidence, self.weights, self.start, self.leak = Evidence(features), weights.tolist(), start, leak

    def judged(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The text's score, and start, end and score of each sentence with evidence."""
        clean, found, w = 1.0 - self.leak, [], self.weights
        for lo, hi, seen in self.evidence.sentences(text):
            z = self.start
            for i in seen:
                z += w[i]
            p = 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))
            clean *= 1.0 - p
            found.append((lo, hi, p))
        return 1.0 - clean, found


def _bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, 64):
            part = b.slice(i, 64)
            seen = [sorted({f for w in set(LETTERS.findall(t.lower())) for f in beginnings(w)}) for t in part["text"].to_pylist()]
            label = np.repeat(part["toxic"].to_numpy(zero_copy_only=False), [len(s) for s in seen])
            yield pa.RecordBatch.from_arrays([pa.array([f for s in seen for f in s], pa.string()), pa.array(label.astype(np.int32))], ["feature", "toxic"])


def _instances(batches: Iterator[pa.RecordBatch], features: list[str]) -> Iterator[pa.RecordBatch]:
    """A text's sentences as numbers: how many beginnings, then those, and so on."""
    evidence = Evidence(features)
    for b in batches:
        rows = [np.array([x for _, _, seen in evidence.sentences(t) for x in (len(seen), *seen)], "<i4").tobytes() for t in b["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["toxic"], pa.array(rows, pa.binary())], ["doc_id", "toxic", "bag"])


def noisy_or(bags: list[np.ndarray], labels: np.ndarray, importance: np.ndarray, initial: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Weights, start and leak that fit the labels best.  bags: as _instances() writes them.

    The mean log-likelihood, each document weighed by its importance, less PRICE for each squared weight, climbed by Adam
    (Kingma and Ba, 2015) from `initial`: a fixed number of steps in fixed order, so that the result doesn't change.
    """
    owner, sentence, feature = [], [], []
    for d, bag in enumerate(bags):
        at, data = 0, bag.tolist()
        while at < len(data):
            n = data[at]
            sentence += [len(owner)] * n
            feature += data[at + 1 : at + 1 + n]
            owner.append(d)
            at += n + 1
    owner, sentence, feature = (np.array(x, np.int64) for x in (owner, sentence, feature))
    k, n = len(initial), len(bags)
    share = importance / max(importance.sum(), 1e-12)
    toxic = labels == 1
    x = np.concatenate([initial, [-6.0, -5.0]])  # the weights, the start, the leak
    mean, square = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, STEPS + 1):
        z = x[k] + np.bincount(sentence, x[feature], len(owner))
        # Minus the logarithm of a sentence's, and a document's, chance of being clean.
        soft = np.logaddexp(0, z)
        clean = np.bincount(owner, soft, n) + np.logaddexp(0, x[k + 1])
        # How the loss changes with that: 1 for a clean document; what is left to explain for a toxic one.
        slope = np.where(toxic, -1 / np.expm1(np.clip(clean, 1e-9, 60)), 1.0) * share
        by = slope[owner] / (1 + np.exp(-z))
        gradient = np.concatenate([np.bincount(feature, by[sentence], k)[:k] + 2 * PRICE * x[:k], [by.sum(), slope.sum() / (1 + math.exp(-x[k + 1]))]])
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        x = x - RATE * (1 - step / (STEPS + 1)) * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
    return x[:k], float(x[k]), float(1 / (1 + math.exp(-x[k + 1])))


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(3)) == 1


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """From labelled documents whose crc32(doc_id) mod 3 is not 1: at most SAMPLE of each label, LONGEST bytes each.

    Beginnings are counted by document and label in Spark; the driver gets FEATURES of them, and the sample's sentences as
    numbers of those.
    """
    marked = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    marked = marked.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    text = docs.select("doc_id", text_of(docs).alias("text"))
    counts = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    parts = [marked.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for y in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # 2 * SAMPLE rows at most
    rows = staged(text.where(F.octet_length("text") <= LONGEST).join(chosen, "doc_id").select("doc_id", "toxic", "text"), "sample")
    many = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = many.get(1, 0), many.get(0, 0)
    if not bad:
        return Model([], np.zeros(0), -6.0, 1e-6 if good else 0.5)
    seen = rows.mapInArrow(_bag, "feature string, toxic int").groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).where(F.col("a") >= LEAST)
    # Twice the log-likelihood ratio of a beginning's share in toxic and in clean documents; only those that toxic ones have more often.
    part = lambda x, y, of, all_of: F.when(x > 0, x * F.ln(x * (bad + good) / (of * y))).otherwise(0.0) if all_of else F.lit(0.0)
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    ratio = 2 * (part(a, a + b, bad, bad) + part(b, a + b, good, good) + part(bad - a, bad + good - a - b, bad, bad) + part(good - b, bad + good - a - b, good, good))
    kept = seen.where(a * max(good, 1) > b * bad).withColumn("ratio", ratio).where(F.col("ratio") >= RATIO)
    kept = kept.orderBy(F.desc("ratio"), "feature").limit(FEATURES).toPandas()
    features = kept["feature"].tolist()
    found = rows.mapInArrow(partial(_instances, features=features), "doc_id long, toxic int, bag binary").toPandas()
    found = found.sort_values(["doc_id", "bag"], kind="stable")
    label = found["toxic"].to_numpy()
    # Each label stands for its share of all labelled rows, whatever the sample holds of it.
    weight = np.where(label == 1, counts.get(1, 0) / bad, counts.get(0, 0) / max(good, 1))
    odds = np.log(((kept["a"] + 0.5) / (bad + 1)) / ((kept["b"] + 0.5) / (good + 1))).to_numpy(float)
    weights, start, leak = noisy_or([np.frombuffer(x, "<i4") for x in found["bag"]], label, weight, odds)
    return Model(features, weights, start, leak)


OFFENCES = "array<struct<start:int,chars:int,score:double>>"


def _judged(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    offence = pa.list_(pa.struct([("start", pa.int32()), ("chars", pa.int32()), ("score", pa.float64())]))
    for b in batches:
        for i in range(0, b.num_rows, 256):
            part = b.slice(i, 256)
            scores, spans = [], []
            for t in part["text"]:
                score, found = model.value.judged(t.as_py())
                scores.append(min(1.0, max(0.0, score)))
                spans.append([{"start": lo, "chars": hi - lo, "score": p} for lo, hi, p in found if p >= 0.5])
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(scores, pa.float64()), pa.array(spans, offence)], ["doc_id", "score", "offences"])


def toxicity(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted (score of at least THRESHOLD), offences.

    offences: start and length in code points, and score, of each sentence that offends with 0.5 or more, in order.  Only
    the whole text is an input; a null text is empty, and an empty one has the leak as its score.  Equal texts have equal
    scores; repeated rows are repeated.  Labels that are neither 0 nor 1, or of unknown documents, are ignored; of
    repeated labels the highest counts.  Without any label each score is 0.5, with clean ones only it is next to 0.
    Other columns, whatever their names, are ignored.  An empty table gives no row.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model or fit(docs, labels))  # FEATURES short strings at most
    rows = docs.select("doc_id", text_of(docs).alias("text"))
    found = rows.mapInArrow(partial(_judged, model=sent), f"doc_id {dict(rows.dtypes)['doc_id']}, score double, offences {OFFENCES}")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "offences")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    worst = F.array_max(F.transform("offences", lambda o: F.struct(o["score"].alias("score"), (-o["start"]).alias("start"), o["chars"].alias("chars"))))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("offences").cast("long").alias("n_offences"), (-worst["start"]).cast("long").alias("worst_start"), worst["chars"].cast("long").alias("worst_chars"))
