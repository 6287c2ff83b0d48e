"""Quality rules whose cutoffs control the risk of false rejection.  DataFrame functions only.

Each rule scores a document (higher is worse) and has a fixed ladder of cutoffs.  In each stratum (language) a part of
the labelled documents proposes a cutoff for each rule, the one that gains most (low documents rejected, less PENALTY for
each good one), and orders the rules by the low documents that they win.  That gives a path of rule sets: rules join in
this order, each first with its cutoff times the largest of FACTORS, then tightened, so each set rejects what the one before it
rejects.  The other labelled good documents, which no proposal has
seen, try the path in that order: a set passes while the exact binomial bound (Clopper and Pearson, 1934) shows that all
its rules together reject at most RISK of the stratum's good documents.  Testing in a fixed order needs no correction along
the path (as in Learn then Test: Angelopoulos et al., 2021); Bonferroni divides ERROR by the number of strata that can
pass.  So with probability 1 - ERROR all strata lose at most RISK of their good documents to cutoffs.  The bound leaves
out what the fixed base rule rejects.  A stratum with too few labels for any set to pass has no cutoffs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WS, staged, table, text_of

RISK, ERROR = 0.02, 0.05
PENALTY = 5
#: What a rule's cutoff is multiplied by, step by step.
FACTORS = (2.0, 1.5, 1.2, 1.0)
#: One labelled good document in so many proposes; the others test.
PART = 4
#: Cutoffs of a rule: 1 to STEPS times its step.
STEPS = 50
RULES = {"symbols": 0.01, "duplicate_lines": 0.02, "repeated_words": 0.004, "capitals": 0.02, "long_words": 0.5, "same_words": 0.02}
WHITE = " \t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    bare = F.btrim(text, F.lit(WHITE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WS + "+"))


def _windows(words: Column, bits: Column) -> Column:
    """Hashes of the 5-word windows, cut to make room for the window's place in the lowest `bits` bits; sorted."""
    n = F.size(words)
    places = F.when(n >= 5, F.sequence(F.lit(0), n - 5)).otherwise(F.array().cast("array<int>"))
    return F.sort_array(F.transform(places, lambda i: F.call_function("shiftleft", F.xxhash64(*(F.get(words, i + k) for k in range(5))), bits).bitwiseOR(i.cast("long"))))


def _twice(windows: Column, bits: Column) -> Column:
    """The sorted windows whose hash the one before or after has too."""
    hashed = lambda x: F.call_function("shiftright", x, bits)
    near = lambda x, other: F.coalesce(hashed(x) == hashed(other), F.lit(False))
    return F.filter(windows, lambda x, k: near(x, F.get(windows, k + 1)) | near(x, F.get(windows, k - 1)))


def _clash(windows: Column, words: Column, bits: Column) -> Column:
    """Whether neighbours with one hash are different windows."""
    hashed = lambda x: F.call_function("shiftright", x, bits)
    place = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1).cast("int")
    pairs = F.transform(windows, lambda x, k: F.struct(x.alias("x"), F.get(windows, k + 1).alias("y")))
    return F.exists(pairs, lambda p: F.coalesce((hashed(p["x"]) == hashed(p["y"])) & (F.slice(words, place(p["x"]) + 1, 5) != F.slice(words, place(p["y"]) + 1, 5)), F.lit(False)))


def _covered(places: Column) -> Column:
    """Words in 5-word windows that start at the sorted places."""
    gained = F.transform(places, lambda x, k: F.least(F.lit(5), F.coalesce(F.get(places, k + 1) - x, F.lit(5))))
    return F.aggregate(gained, F.lit(0).cast("long"), lambda a, x: a + x)


def _exact_places(words: Column) -> Column:
    """Places of repeated windows by the words themselves; for texts where two hashes meet."""
    pairs = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - 5), lambda i: F.struct(F.slice(words, i + 1, 5).alias("w"), i.alias("i"))))

    def repeated(sorted_pairs: Column) -> Column:
        near = lambda x, other: F.coalesce(x["w"] == other["w"], F.lit(False))
        return F.filter(sorted_pairs, lambda x, k: near(x, F.get(sorted_pairs, k + 1)) | near(x, F.get(sorted_pairs, k - 1)))

    # As an element of an array the sorted pairs are made once, not for each element that looks at its neighbours.
    found = F.transform(F.array(pairs), repeated)[0]
    return F.sort_array(F.transform(found, lambda x: x["i"].cast("long")))


def features(docs: DataFrame, exact: bool = False, whole: bool = False) -> DataFrame:
    """doc_id, stratum, the base counts, base_failed, and ranks: for each rule the cutoffs that are reached.

    exact: compare the words of all windows (for tests); else only where hashes of two windows meet.
    whole: add the row itself as a struct `doc`.
    """
    stratum = F.col("lang").cast("string") if "lang" in docs.columns else F.lit("")
    more = ["doc"] if whole else []
    rows = docs.select("doc_id", F.coalesce(stratum, F.lit("")).alias("stratum"), text_of(docs).alias("text"), *([F.struct("*").alias("doc")] if whole else []))
    rows = rows.select("doc_id", "stratum", "text", *more, words_of(F.col("text")).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    rows = rows.select(
        "doc_id", "stratum", *more, "words", lines.alias("lines"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("text", "[^A-Z]+", "")).alias("capitals"),
        F.size("words").cast("long").alias("n_words"), F.length(F.bin(F.size("words"))).alias("bits"),
    )
    rows = rows.withColumn("windows", _windows(F.col("words"), F.col("bits")))
    rows = rows.withColumn("windows", _twice(F.col("windows"), F.col("bits")))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits")) - 1
    quick = F.sort_array(F.transform("windows", lambda x: x.bitwiseAND(mask)))
    careful = F.when(F.size("words") >= 5, _exact_places(F.col("words"))).otherwise(F.array().cast("array<long>"))
    rows = rows.withColumn("places", careful if exact else F.when(_clash(F.col("windows"), F.col("words"), F.col("bits")), careful).otherwise(quick))
    rows = rows.select(
        "doc_id", "stratum", *more, "n_words", "n_symbols", "capitals",
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("words")).alias("n_kinds"), _covered(F.col("places")).alias("n_repeat_words"),
    )
    per = lambda x, y: F.coalesce(F.col(x) / F.nullif(F.col(y), F.lit(0)), F.lit(0.0))
    scores = {
        "symbols": per("n_symbols", "word_chars"), "duplicate_lines": per("n_dup_lines", "n_lines"), "repeated_words": per("n_repeat_words", "n_words"),
        "capitals": per("capitals", "word_chars"), "long_words": per("word_chars", "n_words"), "same_words": F.when(F.col("n_words") > 0, 1 - per("n_kinds", "n_words")).otherwise(0.0),
    }
    ranks = F.array(*(F.least(F.floor(scores[r] / step + 1e-9), F.lit(STEPS)).cast("int") for r, step in RULES.items()))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.select("doc_id", "stratum", *more, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), ranks.alias("ranks"))


def _tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X binomial with n trials and probability p; terms by their logarithms."""
    start = F.struct((n * math.log1p(-p)).cast("double").alias("log"), F.lit(0.0).alias("sum"))

    def step(acc: Column, j: Column) -> Column:
        following = acc["log"] + F.log(F.greatest(n - j, F.lit(1e-300)) / (j + 1)) + math.log(p / (1 - p))
        return F.struct(following.alias("log"), (acc["sum"] + F.exp(acc["log"])).alias("sum"))

    return F.aggregate(F.sequence(F.lit(0).cast("long"), k), start, step, lambda acc: acc["sum"])


def paths(marked: DataFrame) -> DataFrame:
    """marked (stratum, quality, part, ranks), part 0 to propose.  (stratum, path): arrays of a cutoff or null for each rule."""
    ranked = marked.where("quality <> 1 OR part = 0").select("stratum", "quality", F.posexplode("ranks").alias("rule", "rank"))
    good = F.col("quality") == 1
    steps = ranked.groupBy("stratum", "rule", "rank").agg(F.count(F.when(good, 1)).alias("good"), F.count(F.when(~good, 1)).alias("low"))
    # At most rules x (STEPS + 1) rows for each stratum.
    down = Window.partitionBy("stratum", "rule").orderBy(F.desc("rank"))
    steps = steps.select("stratum", "rule", "rank", F.sum("low").over(down).alias("won"), (PART * F.sum("good").over(down)).alias("lost"))
    steps = steps.withColumn("gain", F.col("won") - PENALTY * F.col("lost")).where("rank > 0 AND gain > 0")
    best = steps.groupBy("stratum", "rule").agg(F.max(F.struct("gain", "rank", "won")).alias("best"))
    order = best.groupBy("stratum").agg(F.sort_array(F.collect_list(F.struct(F.col("best.won"), "rule", F.col("best.rank").alias("cut"))), asc=False).alias("order"))

    def cuts(j: Column, factor: float) -> Column:
        known = F.transform("order", lambda x, i: F.struct(x["rule"], F.when(i < j, x["cut"]).when(i == j, F.ceil(x["cut"] * factor)).cast("int")))
        return F.transform(F.sequence(F.lit(0), F.lit(len(RULES) - 1)), lambda r: F.try_element_at(F.map_from_entries(known), r))

    return order.select("stratum", F.flatten(F.transform("order", lambda _, j: F.array(*(cuts(j, f) for f in FACTORS)))).alias("path"))


def _broken(ranks: Column, cuts: Column) -> Column:
    """For each rule whether its cutoff is reached."""
    return F.zip_with(ranks, cuts, lambda r, c: F.coalesce(r >= c, F.lit(False)))


def cutoffs(found: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """found: features().  labels (doc_id, quality).  (stratum, cuts): a cutoff or null for each rule, for the strata where a set passes."""
    labels = labels.groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality IS NOT NULL")
    marked = found.join(labels, "doc_id").where("NOT base_failed").select("stratum", "quality", F.pmod(F.xxhash64("doc_id"), F.lit(PART)).alias("part"), "ranks")
    marked = staged(marked, "marked")
    testing = marked.where("quality = 1 AND part > 0")
    sizes = testing.groupBy("stratum").agg(F.count("*").alias("n"))
    # With n good documents the bound is at least (1 - risk)^n, so a smaller stratum can't pass, whatever it loses.
    tests = max(1, sizes.where(F.col("n") * math.log1p(-risk) <= math.log(error)).count())
    tried = testing.join(paths(marked), "stratum").select("stratum", "ranks", F.posexplode("path").alias("step", "cuts"))
    tried = tried.groupBy("stratum", "step").agg(F.first("cuts").alias("cuts"), F.count("*").alias("n"), F.count(F.when(F.exists(_broken(F.col("ranks"), F.col("cuts")), lambda x: x), 1)).alias("lost"))
    safe = F.when(F.col("lost") > F.col("n") * risk, F.lit(False)).otherwise(_tail(F.col("n"), F.col("lost"), risk) <= error / tests)
    passed = F.min(safe.cast("int")).over(Window.partitionBy("stratum").orderBy("step"))
    return tried.withColumn("passed", passed).where("passed = 1").groupBy("stratum").agg(F.max_by("cuts", "step").alias("cuts"))


def _judged(docs: DataFrame, labels: DataFrame, risk: float, whole: bool) -> DataFrame:
    found = staged(features(docs, whole=whole), "features")
    labels = labels.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 1)
    cuts = staged(cutoffs(found, labels, risk), "cutoffs")
    broken = _broken(F.col("ranks"), F.coalesce("cuts", F.array_repeat(F.lit(None).cast("int"), len(RULES))))
    names = F.filter(F.transform(broken, lambda x, i: F.when(x, F.get(F.array(*map(F.lit, RULES)), i))), lambda x: x.isNotNull())
    judged = found.join(cuts, "stratum", "left").withColumn("broken", names)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))


def quality_rules(docs: DataFrame, labels: DataFrame, risk: float = RISK) -> DataFrame:
    """One row for each row of docs: doc_id, counts, base_failed, broken (rules), kept.

    Null and empty texts have no words and fail the base rule.  Without labels, or with too few, only the base rule
    rejects.  A null or missing lang is a stratum of its own; labels of unknown documents and null labels are ignored;
    of repeated labels the highest counts.  Repeated rows are judged alike.  Other columns are ignored.  Only labels
    with crc32(doc_id) mod 3 other than 1 are used, so the rest stay for measuring.  An empty table gives no row.
    """
    return _judged(docs, labels, risk, False).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "broken", "kept")


def drop_rejected(docs: DataFrame, labels: DataFrame, risk: float = RISK) -> DataFrame:
    """The rows of docs that the rules keep, each as often as it comes, with all columns."""
    return _judged(docs, labels, risk, True).where("kept").select("doc.*")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("broken")
