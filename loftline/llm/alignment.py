"""Cross-tokenizer alignment: where the tokens of two vocabularies end together, and which of them overlap.

Neither vocabulary has a token that reaches over a cut: a space between two characters that aren't white space.  What
lies between two cuts is a run, and its tokens are those it has in the whole text.  A fragment of a text, wherever its ends
are, is an open prefix (up to its first cut), closed groups (the runs between its first and last cut) and an open suffix.
Fragments of neighbouring chunks compose to such a fragment: the left one's suffix and the right one's prefix close, or stay
open if a side has no cut; composition is associative, so a long text's chunks are reduced as a tree, FAN at a time, by
tasks that hold open ends only.  Closed text leaves the tree at once, is aligned where it is, and comes together again in order
of its place, as a stream.

How many documents hold a pair of ids linked is counted from slabs: batches of texts with one dictionary of pairs each.
A slab's dictionary meets the counts in a join and comes back to the slab as a stream before its documents.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache, partial
from itertools import chain
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import discard, staged, table, text_of
from .words import _ranges, forget, slices

LEFT, RIGHT = "byte_bpe_50k.json", "piece_bpe_32k.model"
SPACE = "▁"
#: A cut lies before such a space.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: Characters of a chunk of a long text, and chunks that compose in one step of the tree.
CHUNK, FAN = 1 << 15, 16
#: Bytes of text of a slab, about.
SLAB = 4 << 20
#: Runs that a Python worker remembers between batches, of those that a batch has more than once; runs that are tokenized at once.
REMEMBERED, JOINED = 200_000, 1024


class Fragment(NamedTuple):
    """cut: whether there is a cut.  Without one, prefix is all.  at, end: places of prefix and suffix in the text."""

    cut: bool
    prefix: str
    suffix: str
    at: int
    end: int


def fragment(text: str, at: int) -> tuple[Fragment, list[tuple[int, str]]]:
    """The fragment of a chunk at a place, and (place, text) of its closed groups."""
    cuts = [m.start() for m in CUT.finditer(text)]
    if not cuts:
        return Fragment(False, text, "", at, at), []
    a, z = cuts[0], cuts[-1]
    return Fragment(True, text[:a], text[z:], at, at + z), [(at + a, text[a:z])] if z > a else []


def compose(f: Fragment, g: Fragment) -> tuple[Fragment, list[tuple[int, str]]]:
    """f and then g as one fragment, and what closes between them.  A cut may lie just where they meet."""
    left, place = (f.suffix, f.end) if f.cut else (f.prefix, f.at)
    both = left + g.prefix
    found = CUT.search(both, max(0, len(left) - 2))
    k = found.start() if found else None
    if f.cut and g.cut:
        return Fragment(True, f.prefix, g.suffix, f.at, g.end), [(place, both)]
    if f.cut:
        return (f._replace(suffix=both), []) if k is None else (f._replace(suffix=both[k:], end=place + k), [(place, both[:k])])
    if g.cut:
        return (g._replace(prefix=both, at=place), []) if k is None else (g._replace(prefix=both[:k], at=place), [(place + k, both[k:])])
    return (Fragment(False, both, "", f.at, f.at), []) if k is None else (Fragment(True, both[:k], both[k:], f.at, place + k), [])


def closed(f: Fragment) -> list[tuple[int, str]]:
    """What is left open at the ends of a whole text."""
    return [x for x in ((f.at, f.prefix), (f.end, f.suffix) if f.cut else (f.at, "")) if x[1]]


def _byte_letters() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Aligner:
    """Runs and what they hold, remembered between batches."""

    def __init__(self, left: str = LEFT, right: str = RIGHT):
        self.a = Tokenizer.from_file(public_tokenizers.path(left))
        self.a.encode_special_tokens = True  # their strings are plain text
        self.a.no_truncation()
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(right))
        letters = _byte_letters()
        words = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(words.values()) + 1)
        for w, i in words.items():
            self.a_bytes[i] = bytes(letters[c] for c in w) if all(c in letters for c in w) else w.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for i, p in enumerate(pieces) if not self.b.is_control(i) and not self.b.is_unknown(i) and not self.b.is_byte(i)):
            raise ValueError("a piece reaches over a space")
        spell = lambda n, mark: np.array([f"{mark}{i}" for i in range(n)], object)
        self.a_text = np.stack([spell(len(self.a_bytes), m) for m in ("", ";", ",")])
        self.b_text = np.stack([spell(len(self.b_bytes), m) for m in ("|", ",")])
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self._cut(0)

    def _cut(self, n: int) -> None:
        """Of the runs' contents the first n stay.  sums: ends of n_a, n_b, n_groups and links up to each run."""
        if not n:
            self.text: list[str | None] = []
            self.sums, self.codes = np.zeros((1, 4), np.int64), np.zeros(0, np.uint32)
        else:
            del self.text[n:]
            self.sums = self.sums[: n + 1]
            self.codes = self.codes[: self.sums[-1, 3]]

    def _learn(self, runs: list[str], into: dict[str, int]) -> None:
        """Runs without the space before them."""
        easy = [r for r in runs if not r[0].isspace() and not r[-1].isspace() and SPACE not in r]
        hard = [r for r in runs if r[0].isspace() or r[-1].isspace() or SPACE in r]
        groups = [easy[i : i + JOINED] for i in range(0, len(easy), JOINED)] + [[r] for r in hard]
        texts = [" ".join(g) for g in groups]
        counts, codes = [], []
        for start in range(0, len(groups), 16):
            part = slice(start, start + 16)
            ids_a = [x.ids for x in self.a.encode_batch_fast([" " + t for t in texts[part]], add_special_tokens=False)]
            for g, t, a, b in zip(groups[part], texts[part], ids_a, self.b.encode(texts[part], num_threads=1), strict=True):
                self._aligned(g, (" " + t).encode(), a, b, into, counts, codes)
        self.sums = np.concatenate([self.sums, self.sums[-1] + np.cumsum(np.concatenate(counts), 0)]) if counts else self.sums
        self.codes = np.concatenate([self.codes, *codes])

    def _aligned(self, runs: list[str], data: bytes, ids_a: list[int], ids_b: list[int], into: dict[str, int], counts: list, codes: list) -> None:
        same = b"".join(map(self.a_bytes.__getitem__, ids_a)) == data and b"".join(map(self.b_bytes.__getitem__, ids_b)) == data
        a, b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        end_a, end_b = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        ends = np.cumsum([1 + len(r.encode()) for r in runs])
        # Between two neighbouring ends just one token of each side goes on, and a pair overlaps in one such stretch.
        stretch = np.sort(np.concatenate([end_a, end_b]), kind="stable")
        again = np.diff(stretch, prepend=-1) == 0
        common, stretch = stretch[again], stretch[~again]
        whole = same and len(common) and (common[np.minimum(np.searchsorted(common, ends), len(common) - 1)] == ends).all()
        if not whole and len(runs) > 1:
            for r in runs:
                data = (" " + r).encode()
                self._aligned([r], data, self.a.encode_batch_fast([data.decode()], add_special_tokens=False)[0].ids, self.b.encode(r), into, counts, codes)
            return
        first = len(self.text)
        into.update(zip(runs, range(first, first + len(runs)), strict=True))
        if not whole:  # one run whose tokens don't spell it
            self.text.append(None)
            counts.append(np.zeros((1, 4), np.int64))
            return
        codes.append((a[np.searchsorted(end_a, stretch)] << 16 | b[np.searchsorted(end_b, stretch)]).astype(np.uint32))
        group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        run_of = np.searchsorted(ends, common)  # of each group
        many = [np.bincount(x, minlength=len(runs)) for x in (run_of[group_a], run_of[group_b], run_of, np.searchsorted(ends, stretch))]
        counts.append(np.stack(many, 1))
        # In order: of each group the tokens of the one side, then those of the other.
        new_a, new_b = np.diff(group_a, prepend=-1) != 0, np.diff(group_b, prepend=-1) != 0
        new_run = np.diff(run_of, prepend=-1) != 0
        words = np.empty(len(a) + len(b), object)
        words[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = self.a_text[np.where(new_a, np.where(new_run[group_a], 0, 1), 2), a]
        words[np.arange(len(b)) + np.searchsorted(group_a, group_b, side="right")] = self.b_text[np.where(new_b, 0, 1), b]
        words, cuts = words.tolist(), [0, *np.cumsum(many[0] + many[1]).tolist()]
        self.text += ["".join(words[lo:hi]) for lo, hi in zip(cuts, cuts[1:], strict=False)]

    def align(self, texts: list[str]) -> tuple[list[tuple[int, int, int, int]], list[str | None], np.ndarray, np.ndarray]:
        """Texts that begin with the space put before them, or with the space of a cut; not empty.

        For each: n_a, n_b, n_groups, n_links; its groups as text, or None if tokens don't spell it.  And the links of all
        texts one after another: text, code (left id, 16 bits right id).  Runs that come once are forgotten at the end.
        """
        runs = [CUT.split(t) for t in texts]
        for r in runs:
            r[0] = r[0][1:]
        if len(self.known) > REMEMBERED:
            self._forget()
        met = Counter(chain.from_iterable(runs))
        new = [r for r in met if r not in self.known]
        self._learn([r for r in new if met[r] > 1], self.known)
        stay, once = len(self.text), {}
        self._learn([r for r in new if met[r] == 1], once)
        once |= self.known if len(self.known) < len(met) else {r: self.known[r] for r in met if r in self.known}
        number, text = once.__getitem__, self.text
        at = [list(map(number, r)) for r in runs]
        shown: list[str | None] = []
        for x in at:
            words = list(map(text.__getitem__, x))
            shown.append(None if None in words else ";".join(words))
        flat = np.fromiter(chain.from_iterable(at), np.int64, sum(map(len, at)))
        owner = np.repeat(np.arange(len(texts)), list(map(len, at)))
        good = np.array([x is not None for x in shown], bool)
        flat, owner = flat[good[owner]], owner[good[owner]]
        sums = np.zeros((len(texts), 4), np.int64)
        each = self.sums[flat + 1] - self.sums[flat]
        cuts = np.flatnonzero(np.diff(owner, prepend=-1))
        if len(cuts):
            sums[owner[cuts]] = np.add.reduceat(each, cuts)
        codes = self.codes[_ranges(self.sums[flat, 3], each[:, 3])]
        self._cut(stay)
        return list(map(tuple, sums.tolist())), shown, np.repeat(owner, each[:, 3]), codes


@cache
def aligner(left: str, right: str) -> Aligner:
    return Aligner(left, right)


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers under 2^32, small as a rule: compressed byte by byte."""
    return zlib.compress(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u4")


SLABS = "slab long, doc_ids array<long>, stats array<array<long>>, shas array<string>, pairs binary, in_docs binary, sizes binary, places binary, times binary"
_NAMES = [x.split()[0] for x in SLABS.split(", ")]
_TYPES = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64())), pa.list_(pa.string()), *[pa.binary()] * 5]


def _slab(number: int, doc_ids: list, stats: list, shas: list, owner: np.ndarray, codes: np.ndarray, times: np.ndarray | None = None) -> pa.RecordBatch:
    """One row: a dictionary of pairs (and how many of the documents hold each), and each document's pairs in it.

    owner, codes: the links, of which repeated ones count; or distinct pairs with times.
    """
    key = owner.astype(np.uint64) << np.uint64(32) | codes.astype(np.uint64)
    if times is None:
        key, times = np.unique(key, return_counts=True)
    pairs, place, in_docs = np.unique((key & np.uint64(0xFFFFFFFF)).astype(np.uint32), return_inverse=True, return_counts=True)
    sizes = np.bincount((key >> np.uint64(32)).astype(np.int64), minlength=len(doc_ids))
    row = (number, doc_ids, stats, shas, _packed(np.diff(pairs, prepend=np.uint32(0))), _packed(in_docs), _packed(sizes), _packed(place), _packed(times))
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _TYPES, strict=True)], _NAMES)


def _short(batches: Iterator[pa.RecordBatch], left: str, right: str) -> Iterator[pa.RecordBatch]:
    """Slabs of texts (doc_id, text) that are short enough for a task."""
    task, k = TaskContext.get().partitionId(), 0
    for b in batches:
        for lo, part in slices(b["text"], SLAB):
            texts = part.to_pylist()
            full = [i for i, t in enumerate(texts) if t]
            sums, shown, owner, codes = aligner(left, right).align([" " + texts[i] for i in full])
            stats, shas = [[0, 0, 0, 0]] * len(texts), [""] * len(texts)
            for i, s, x in zip(full, sums, shown, strict=True):
                if x is not None:
                    stats[i], shas[i] = list(s), hashlib.sha256(x.encode()).hexdigest()
            yield _slab(task << 33 | k << 1, b["doc_id"].slice(lo, len(part)).to_pylist(), stats, shas, np.array(full, np.int64)[owner], codes)
            k += 1


def _chunks(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for key, doc, text in zip(*(b[c] for c in ("key", "doc_id", "text")), strict=True):
            text = " " + text.as_py()
            for k, at in enumerate(range(0, len(text), chunk)):
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((key.as_py(), pa.int64()), (doc.as_py(), pa.int64()), (k, pa.int64()), (at, pa.int64()), (text[at : at + chunk], pa.string()))], ["key", "doc_id", "k", "at", "text"])


TREE = "key long, doc_id long, k long, cut boolean, prefix string, suffix string, at long, end long, closed string"
_TREE_NAMES = [x.split()[0] for x in TREE.split(", ")]
_TREE_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]


def _tree_rows(rows: Iterable[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), _TREE_TYPES, strict=True)], _TREE_NAMES)


def _out(key: int, doc: int, k: int, f: Fragment | None, done: list[tuple[int, str]]) -> pa.RecordBatch:
    """A fragment, and closed text as rows of its own."""
    rows = [(key, doc, None, None, None, None, at, None, text) for at, text in done]
    return _tree_rows(rows if f is None else [(key, doc, k, f.cut, f.prefix, f.suffix, f.at, f.end, None), *rows])


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            f, done = fragment(r["text"], r["at"])
            yield _out(r["key"], r["doc_id"], r["k"], f, done)


def _composed(batches: Iterator[pa.RecordBatch], last: bool, fan: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key and k: neighbours with one k // fan compose.  last: what is open at the ends closes."""
    now, f, done = None, None, []

    def out() -> pa.RecordBatch:
        key, doc, k = now
        return _out(key, doc, k, None if last else f, done + closed(f) if last else done)

    for b in batches:
        for r in b.to_pylist():
            at = (r["key"], r["doc_id"], r["k"] // fan)
            g = Fragment(*(r[c] for c in Fragment._fields))
            if at != now:
                if now:
                    yield out()
                now, f, done = at, g, []
                continue
            f, more = compose(f, g)
            done += more
    if now:
        yield out()


PIECES = "key long, doc_id long, at long, good boolean, stats array<long>, groups binary, codes binary, times binary"


def _pieces(batches: Iterator[pa.RecordBatch], left: str, right: str) -> Iterator[pa.RecordBatch]:
    """Closed text (key, doc_id, at, closed): its groups, and its pairs with how often each is linked."""
    for b in batches:
        for lo, part in slices(b["closed"], SLAB):
            texts = part.to_pylist()
            sums, shown, owner, codes = aligner(left, right).align(texts)
            ends = np.searchsorted(owner, np.arange(len(texts) + 1))
            rows = []
            for i, (s, x) in enumerate(zip(sums, shown, strict=True)):
                pairs, times = np.unique(codes[ends[i] : ends[i + 1]], return_counts=True)
                rows.append((x is not None, list(s), zlib.compress((x or "").encode(), 1), _packed(np.diff(pairs, prepend=np.uint32(0))), _packed(times)))
            cols = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.bool_(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b[c].slice(lo, len(part)) for c in ("key", "doc_id", "at")), *cols], [x.split()[0] for x in PIECES.split(", ")])


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces come sorted by key and place: a slab for each long text, which holds its distinct pairs and no more."""
    task, k, now = TaskContext.get().partitionId(), 0, None

    def start(key: int, doc: int) -> dict:
        return {"key": key, "doc": doc, "good": True, "stats": np.zeros(4, np.int64), "sha": hashlib.sha256(), "codes": np.zeros(0, np.uint32), "times": np.zeros(0, np.int64), "any": False}

    def out() -> pa.RecordBatch:
        if not now["good"]:
            return _slab(task << 33 | k << 1 | 1, [now["doc"]], [[0] * 4], [""], np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64))
        return _slab(task << 33 | k << 1 | 1, [now["doc"]], [now["stats"].tolist()], [now["sha"].hexdigest()], np.zeros(len(now["codes"]), np.int64), now["codes"], now["times"])

    for b in batches:
        for r in b.to_pylist():
            if now is None or r["key"] != now["key"]:
                if now:
                    yield out()
                    k += 1
                now = start(r["key"], r["doc_id"])
            if not r["good"]:
                now["good"] = False
            now["sha"].update((b";" if now["any"] else b"") + zlib.decompress(r["groups"]))
            now["any"] = True
            now["stats"] += np.array(r["stats"])
            codes, place = np.unique(np.concatenate([now["codes"], np.cumsum(_unpacked(r["codes"]), dtype=np.uint32)]), return_inverse=True)
            now["times"] = np.bincount(place, np.concatenate([now["times"], _unpacked(r["times"])]), len(codes)).astype(np.int64)
            now["codes"] = codes
    if now:
        yield out()


def _long(docs: DataFrame, left: str, right: str, chunk: int, fan: int) -> DataFrame:
    """Slabs of texts longer than a chunk, by a tree of fragments."""
    rows = docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text")
    chunks = staged(rows.mapInArrow(partial(_chunks, chunk=chunk), "key long, doc_id long, k long, at long, text string"), "chunks")
    most = chunks.agg(F.max("k").alias("k")).first()["k"]
    tree = staged(chunks.repartition("key", "k").mapInArrow(_opened, TREE), "fragments")
    discard(chunks)
    done = []
    while True:
        done.append(tree.where("closed IS NOT NULL"))
        if most is None or tree.where("closed IS NULL").isEmpty():
            break
        last = most < fan
        most //= fan
        ordered = tree.where("closed IS NULL").repartition("key", F.floor(F.col("k") / fan)).sortWithinPartitions("key", "k")
        tree = staged(ordered.mapInArrow(partial(_composed, last=last, fan=fan), TREE), "fragments")
    text = done[0]
    for more in done[1:]:
        text = text.unionByName(more)
    text = text.select("key", "doc_id", "at", "closed").repartition("key", "at")
    pieces = staged(text.mapInArrow(partial(_pieces, left=left, right=right), PIECES), "pieces")
    return pieces.repartition("key").sortWithinPartitions("key", "at").mapInArrow(_assembled, SLABS)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    for b in batches:
        for slab, pairs, n in zip(*(b[c] for c in ("slab", "pairs", "in_docs")), strict=True):
            pairs, n = np.cumsum(_unpacked(pairs.as_py()), dtype=np.uint32), _unpacked(n.as_py())
            for i in range(0, len(pairs), 1 << 16):
                part = slice(i, i + (1 << 16))
                size = len(pairs[part])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(size, slab.as_py())), pa.array(np.arange(i, i + size, dtype=np.int32)), pa.array(pairs[part].astype(np.int64)), pa.array(n[part].astype(np.int64))], ["slab", "place", "pair", "n"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by slab and kind: a slab's dictionary, in rows with counts, and then the slab itself."""
    now, n, best = None, [], []
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    for b in batches:
        slab, kind = (b[c].to_numpy(zero_copy_only=False) for c in ("slab", "kind"))
        cuts = np.flatnonzero((np.diff(slab) != 0) | (np.diff(kind) != 0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(slab)], strict=True):
            if not b.num_rows:
                continue
            if slab[lo] != now:
                now, n, best = slab[lo], [], []
            if kind[lo] == 0:
                n.append((b["place"].slice(lo, hi - lo).to_numpy(zero_copy_only=False), b["n"].slice(lo, hi - lo).to_numpy(zero_copy_only=False), b["best"].slice(lo, hi - lo).to_numpy(zero_copy_only=False)))
                continue
            row = {c: b[c][lo].as_py() for c in ("doc_ids", "stats", "shas", "sizes", "places", "times")}
            size = sum(len(x[0]) for x in n)
            count, top = np.zeros(size, np.int64), np.zeros(size, bool)
            for place, x, y in n:
                count[place], top[place] = x, y
            owner = np.repeat(np.arange(len(row["doc_ids"])), _unpacked(row["sizes"]))
            place, times = _unpacked(row["places"]), _unpacked(row["times"]).astype(np.int64)
            sums = np.zeros((2, len(row["doc_ids"])), np.int64)
            np.add.at(sums[0], owner, times * top[place])
            np.add.at(sums[1], owner, times * count[place])
            stats = np.array(row["stats"], np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), *(pa.array(x) for x in stats.T.copy()), pa.array(sums[0]), pa.array(sums[1]), pa.array(row["shas"], pa.string())], names)


def align(docs: DataFrame, left: str = LEFT, right: str = RIGHT, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """One row for each row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Tokens of a space and the whole text by the left vocabulary, of the text by the right one; strings of special tokens are
    plain text.  A null or empty text, and one that its tokens don't spell (U+2581 is a space to the right one), has no
    tokens: zeros, and an empty string for the digest.  Repeated rows are rows like any others, in counts too; a null doc_id
    stays null.  A text without a cut is one run, however long, and is tokenized in one task.  docs needs doc_id and text;
    other columns are ignored.  An empty table gives no row.
    """
    rows = docs.select("doc_id", text_of(docs).alias("text"))
    short = rows.where(F.length("text") <= chunk).mapInArrow(partial(_short, left=left, right=right), SLABS)
    slabs = staged(short.unionByName(_long(rows.where(F.length("text") > chunk), left, right, chunk, fan)), "slabs")
    entries = slabs.select("slab", "pairs", "in_docs").mapInArrow(_entries, "slab long, place int, pair long, n long")
    counts = staged(entries.groupBy("pair").agg(F.sum("n").alias("n")), "counts")
    best = counts.groupBy(F.shiftright("pair", 16).alias("a")).agg(F.max("n").alias("most"))  # at most a row for each left id
    counts = counts.withColumn("a", F.shiftright("pair", 16)).join(best, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    known = entries.select("slab", "place", "pair").join(counts, "pair").select("slab", F.lit(0).alias("kind"), "place", "n", "best")
    whole = slabs.select("slab", F.lit(1).alias("kind"), "doc_ids", "stats", "shas", "sizes", "places", "times")
    both = known.unionByName(whole, allowMissingColumns=True).repartition("slab").sortWithinPartitions("slab", "kind")
    return both.mapInArrow(_counted, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
