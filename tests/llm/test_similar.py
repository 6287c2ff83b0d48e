"""The pipeline's near-duplicates by five-word Jaccard similarity, against all pairs."""

import random

import pytest

import corpus_pipeline
from loftline.llm import similar, simhash
from loftline.llm.common import table
from tests.llm.test_operators import HARD, brute_components, brute_print, docs_of


def brute_shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def jaccard(x, y):
    return len(x & y) / len(x | y) if x and y else 0


def near_texts(n=40):
    """Texts, each followed by copies with a few changed words."""
    r, rows = random.Random(3), []
    for i in range(n):
        words = [f"w{r.randrange(5000)}" for _ in range(r.randrange(80, 300))]
        for k in range(4):
            copy = list(words)
            for at in r.sample(range(len(copy)), k * len(copy) // 100):
                copy[at] = f"c{r.randrange(5000)}"
            rows.append((10 * i + k, " ".join(copy)))
    return rows


def brute_kept(rows):
    """Ids left when three bits or a similarity of 0.8 link."""
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    prints, sets = [brute_print(t) for _, t in rows], [brute_shingles(t) for _, t in rows]
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3 or jaccard(sets[a], sets[b]) >= 0.8:
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    return set(least.values())


def test_stage_finds_similar_texts(spark, sf_dir):
    made = near_texts()
    for rows in (made, [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()]):
        got = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs_of(spark, rows), sf_dir).collect()]
        assert sorted(got) == sorted(brute_kept(rows))
    far = sum(jaccard(brute_shingles(a), brute_shingles(b)) >= 0.8 and (brute_print(a) ^ brute_print(b)).bit_count() > 3 for (i, a) in made for (j, b) in made if i < j < i + 4)
    assert far > 10


@pytest.mark.parametrize("size", [512, 7])
def test_large_family(spark, monkeypatch, size):
    """Copies of one text with many changes: some link, some don't; with parts of 7 texts each two parts meet."""
    monkeypatch.setattr(similar, "TEXTS", size)
    r = random.Random(8)
    base, rows = [f"w{k}" for k in range(150)], []
    for i in range(60):
        words = list(base)
        for at in r.sample(range(150), r.randrange(8)):
            words[at] = f"c{i}"
        rows.append((i, " ".join(words)))
    got = simhash.near_duplicates(docs_of(spark, rows), similarity=0.8).where("kept").collect()
    want = brute_kept(rows)
    assert {x["doc_id"] for x in got} == want and 1 < len(want) < 50


def test_bands_miss_no_similar_pair():
    rows = [(i, brute_shingles(t), set(similar.bands(similar.shingles(t.encode())).tolist())) for i, t in near_texts(80)]
    pairs = [(a, b) for k, a in enumerate(rows) for b in rows[k + 1 : k + 4] if jaccard(a[1], b[1]) >= 0.8]
    assert len(pairs) > 50 and all(a[2] & b[2] for a, b in pairs)


def test_similar_hard_cases(spark):
    docs = docs_of(spark, HARD)
    got = simhash.near_duplicates(docs, similarity=0.8).collect()
    want = brute_components([i for i, _ in HARD], [brute_print(t) for _, t in HARD])
    assert sorted(str(r["component_id"]) for r in got) == sorted(map(str, want))
    assert simhash.near_duplicates(docs_of(spark, []), similarity=0.8).count() == 0
