"""Alignment of two vocabularies against a brute-force version, and the fragments' algebra."""

import collections
import hashlib
from functools import reduce

import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loftline.llm import alignment
from loftline.llm.common import table

HARD = [
    (None, None), (5, ""), (5, " "), (5, "  a  b "), (6, "x▁y " * 30), (7, "a\n b\t c  d  \n" * 20), (8, "z" * 500), (9, "<|endoftext|> </s> <s> <unk> <0x41>" * 5), (None, "\x00\x1c a \x85b c" * 7),
    (10, "é 日本語 テスト 😀 " * 20), (11, "it's 've   they 'll " * 9), (12, "same text"), (12, "same text"), (13, "one " * 3000),
]


def brute(rows):
    a_model, b_model = Tokenizer.from_file(public_tokenizers.path(alignment.LEFT)), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(alignment.RIGHT))
    a_model.encode_special_tokens = True
    letters, names = alignment._byte_letters(), {i: w for w, i in a_model.get_vocab().items()}
    a_bytes = lambda i: bytes(letters[c] for c in names[i])
    b_bytes = lambda i: bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode()
    found, held = [], collections.Counter()
    for doc, text in rows:
        a = a_model.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        data = (" " + (text or "")).encode()
        if not text or b"".join(map(a_bytes, a)) != data or b"".join(map(b_bytes, b)) != data:
            found.append((doc, None))
            continue
        ends = [[sum(len(x) for x in parts[: k + 1]) for k in range(len(parts))] if len(parts) < 400 else running(parts) for parts in ([*map(a_bytes, a)], [*map(b_bytes, b)])]
        links, groups, ga, gb, i, j = [], [], [], [], 0, 0
        while i < len(a):
            links.append((a[i], b[j]))
            one, other = ends[0][i], ends[1][j]
            if one <= other:
                ga.append(a[i])
                i += 1
            if other <= one:
                gb.append(b[j])
                j += 1
            if one == other:
                groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
                ga, gb = [], []
        held.update(set(links))
        found.append((doc, (len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest())))
    best = collections.Counter()
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    rows = [(d, 0, 0, 0, 0, 0, 0, "") if r is None else (d, *r[:3], len(r[3]), sum(held[x] == best[x[0]] for x in r[3]), sum(held[x] for x in r[3]), r[4]) for d, r in found]
    return sorted(rows, key=str)


def running(parts):
    at, out = 0, []
    for x in parts:
        at += len(x)
        out.append(at)
    return out


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_documents_equal_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert got(alignment.op13_alignment(spark, sf_dir)) == brute(rows)


def test_hard_texts_in_one_task_and_in_chunks(spark):
    docs = spark.createDataFrame(HARD, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("Slab", "key", "pair", "kind", "closed", "N")})
    want = brute(HARD)
    assert got(alignment.align(docs)) == want
    for chunk, fan in ((7, 2), (64, 3)):
        assert got(alignment.align(docs, chunk=chunk, fan=fan)) == want
    assert alignment.align(docs.where("false")).count() == 0


def whole(text, sizes):
    """Fragments of chunks of these sizes, then a single one."""
    parts, at = [], 0
    for n in [*sizes, len(text)]:
        if at < len(text):
            parts.append(alignment.fragment(text[at : at + n], at))
            at += n
    return parts


def combined(x, y):
    f, more = alignment.compose(x[0], y[0])
    return f, x[1] + more + y[1]


def pieces(x):
    """What a fragment has closed, and what its ends close at last, run by run."""
    done = sorted(x[1] + alignment.closed(x[0]))
    assert [at for at, _ in done] == [0, *running([t for _, t in done])][:-1]
    return [r for _, t in done for r in alignment.CUT.split(t)]


@settings(deadline=None, max_examples=300)
@given(st.text(" ab\n.", max_size=60), st.lists(st.integers(1, 9), max_size=20))
def test_fragments_compose_in_any_order(text, sizes):
    text = " " + text
    parts = whole(text, sizes)
    left = reduce(combined, parts)
    right = parts[-1]
    for p in reversed(parts[:-1]):
        right = combined(p, right)
    tree = parts
    while len(tree) > 1:
        tree = [reduce(combined, tree[i : i + 3]) for i in range(0, len(tree), 3)]
    runs = [r.removeprefix(" ") if k else r for k, r in enumerate(alignment.CUT.split(text))]
    joined = lambda x: [r.removeprefix(" ") if k else r for k, r in enumerate(pieces(x))]
    assert left[0] == right[0] == tree[0][0]
    assert joined(left) == joined(right) == joined(tree[0]) == runs
