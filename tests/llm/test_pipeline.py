"""The pipeline against a brute-force version of each stage on its own input."""

import collections
import re

import corpus_pipeline
from loftline.llm import quality_model, quality_rules
from loftline.llm.common import staged, table
from pyspark.sql import functions as F
from tests.llm.test_operators import HARD, check_packed, docs_of
from tests.llm.test_similar import brute_kept

import public_tokenizers
from tokenizers import Tokenizer

from loftline.llm.words import VOCABULARY


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    names = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "exact_dedup", "near_dedup", "best_fit_packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = staged(stage(spark, docs, sf_dir))
        if name == "quality_classifier":
            want = {r["doc_id"] for r in quality_model.quality_scores(docs, labels).where("score >= 0.5").collect()}
        elif name == "quality_rules":
            want = {r["doc_id"] for r in quality_rules.quality_rules(docs, labels).where("kept").collect()}
        elif name == "exact_dedup":
            groups = collections.defaultdict(list)
            for i, t in before.items():
                groups[re.sub("[ \t-\r]", "", t or "")].append((-len(t or ""), i))
            want = {min(g)[1] for g in groups.values()}
        elif name == "near_dedup":
            want = brute_kept(list(before.items()))
        else:
            check_packed(out.collect(), list(before.items()), Tokenizer.from_file(public_tokenizers.path(VOCABULARY)))
            break
        assert out.columns == names
        got = [r["doc_id"] for r in out.collect()]
        assert sorted(got) == sorted(want)
        docs = out
    assert corpus_pipeline.run(spark, sf_dir).count() == out.count()


def test_stages_on_hard_rows(spark, sf_dir):
    """Null ids and texts, repeated rows, columns that clash in any letter case, a very long text, no row at all: exact rows."""
    long_text = " ".join(f"w{k}" for k in range(40_000))
    rows = [*HARD, (20, long_text), (20, long_text), (None, long_text + " more"), (21, None), (22, " ".join(f"v{k}" for k in range(40)))]
    names = ("_digest", "_SCORE", "Digest", "doc", "STRATUM", "Fp", "root", "Kept", "rank", "seq", "SHA", "Tid")
    labels = table(spark, sf_dir, "labels")
    for docs in (docs_of(spark, rows).withColumns({c: F.concat(F.lit(f"{c} of "), F.coalesce(F.col("text").substr(1, 9), F.lit("none"))) for c in names}), docs_of(spark, []).withColumn("_digest", F.lit(1))):
        before = collections.Counter(map(tuple, docs.collect()))
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            if name == "best_fit_packing":
                check_packed(out.collect(), [(r["doc_id"], r["text"]) for r in docs.collect()], Tokenizer.from_file(public_tokenizers.path(VOCABULARY)))
                continue
            assert out.columns == docs.columns
            after = collections.Counter(map(tuple, out.collect()))
            assert all(n <= before[r] for r, n in after.items())  # whole rows, as they were
            ids = [r[0] for r in after.elements()]
            if name == "quality_classifier":
                scores = {r["doc_id"]: r["score"] for r in quality_model.quality_scores(docs.where("doc_id IS NOT NULL"), labels).collect()}
                assert {r: n for r, n in after.items() if r[0] is not None} == {r: n for r, n in before.items() if r[0] is not None and scores[r[0]] >= 0.5}
            elif name == "quality_rules":
                kept = {(r["doc_id"], r["n_words"], r["kept"]) for r in quality_rules.quality_rules(docs, labels).collect()}
                words = lambda t: len([w for w in re.split("[ \t-\r]+", t or "") if w])
                assert after == {r: n for r, n in before.items() if (r[0], words(r[1]), True) in kept}
            elif name == "exact_dedup":
                groups = collections.defaultdict(list)
                for r in before:
                    groups[re.sub("[ \t-\r]", "", r[1] or "")].append((-len(r[1] or ""), r[0] is not None, r[0] or 0, r[0]))
                assert collections.Counter(ids) == collections.Counter(min(g, key=lambda x: (x[0], not x[1], x[2]))[3] for g in groups.values())
            else:
                known = [(r[0], r[1]) for r in before if r[0] is not None]
                assert set(ids) - {None} == brute_kept(known)
        assert before or not after
