"""The Merkle manifest against a brute-force tree."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from loftline.llm import merkle
from loftline.llm.registry import QUERIES, SQL
from tests.oracle import compare

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return digest(*("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in merkle.FIELDS))


def tree(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def brute(rows, fanout):
    langs = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r))):
        langs.setdefault(r["lang"], []).append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = [tree([leaf_of(r) for r in langs[x]], fanout) for x in order]
    top = tree([t[-1][0] for t in trees], fanout)
    found = []
    for k, x in enumerate(order):
        for i, r in enumerate(langs[x]):
            node = leaf_of(r)
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"]:
                node = leaf_of(r | {"text": "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])})
            proof = []
            for levels, at in ((trees[k], i), (top, k)):
                for nodes in levels[:-1]:
                    lo = at - at % fanout
                    run = nodes[lo : lo + fanout]
                    proof += run[: at - lo] + run[at - lo + 1 :]
                    node = digest(*run[: at - lo], node, *run[at - lo + 1 :])
                    at //= fanout
            found.append((r["doc_id"], leaf_of(r), trees[k][-1][0], top[-1][0], digest(*proof), node, node == top[-1][0]))
    return sorted(found, key=str)


def random_rows(n, langs, seed):
    r = random.Random(seed)
    lang = lambda: r.choice([None, "", *(f"l{i}" for i in range(langs))]) if r.random() < 0.6 else "l0"
    return [{"doc_id": r.choice([None, *range(n)]), "source": r.choice([None, "s"]), "lang": lang(), "n_chars": r.choice([None, 5]), "text": r.choice([None, "", "Ab", "xY", "é", "E" * 999])} for _ in range(n)]


# Blocks of two leaves have many rounds; 20 languages have rounds of their own; the last one has ragged ends everywhere.
@pytest.mark.parametrize(("n", "langs", "fanout", "levels"), [(0, 1, 2, 1), (1, 1, 2, 1), (150, 1, 2, 1), (200, 20, 2, 1), (301, 11, 3, 1), (500, 4, 3, 2)])
def test_manifest_equals_brute_force(spark, n, langs, fanout, levels):
    rows = random_rows(n, langs, n)
    docs = spark.createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in rows], SCHEMA).withColumns({c: F.lit("x") for c in ("Leaf", "Q", "proof", "task", "tie")})
    assert sorted(map(tuple, merkle.manifest(docs, fanout, levels).collect()), key=str) == brute(rows, fanout)


def test_fields_do_not_run_together(spark):
    rows = [(1, "b", "en", "a", 1), (1, "", "en", "ab", 1), (1, None, "en", "ab", 1)]
    assert len({r["leaf"] for r in merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()}) == 3


def test_tampering_shows(spark):
    rows = [(i, "Capital", "en", None, None) for i in range(40)]
    for r in merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect():
        assert r["verified"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 != 0) == (r["folded_root"] == r["root"])


def test_query_matches_sql(spark, sf_dir):
    compare(spark, sf_dir, QUERIES["op12_merkle_manifest"], SQL["op12_merkle_manifest"])
