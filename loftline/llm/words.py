"""Token ids by the tokenizers library, each distinct piece of a partition encoded once.

The vocabulary drops white space: no token spans it.  So the ids of a text are those of its runs without ASCII white
space, in order, and a run of letters that ASCII marks follow is the run and the marks.  A partition's texts are cut
with Arrow, the distinct pieces go through the library, and the ids are gathered with NumPy.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

VOCABULARY = "word_bpe_49k.json"
#: Bytes of text that are cut at once.
SLICE = 1 << 23
#: Marks that are one token run of their own after letters; none of them joins an apostrophe form or composes.
MARKS = ".,!?;:*#$%&|"
#: Letters that are still letters when normalised and in lower case; U+0130 is not.
LETTERS = r"A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}\x{410}-\x{44F}"


class Encoder:
    """Encodes many texts; remembers the pieces it has met."""

    #: Put before each run; and whether a run of letters may be cut from the marks after it.
    HEAD, CUT = "", True
    #: Pieces that a Python worker remembers between batches.
    REMEMBERED = 700_000

    def __init__(self, name: str = VOCABULARY):
        self.library = Tokenizer.from_file(public_tokenizers.path(name))
        self.library.no_truncation()
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True
        self._forget()

    def _runs(self, texts: pa.Array) -> pa.Array:
        """The texts so that a space, and nothing else, separates runs."""
        return _folded(texts)

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.starts, self.lengths = np.zeros(1 << 16, np.uint16), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.used = 0

    def _library(self, pieces: list[str]) -> list[list[int]]:
        """Letters are one token run each, so many go through the library in one string, to be cut at word ends."""
        found: list[list[int]] = [[]] * len(pieces)
        letters = [i for i, x in enumerate(pieces) if x.isalpha()]
        alone = [i for i, x in enumerate(pieces) if not x.isalpha()]
        groups = [letters[i : i + 64] for i in range(0, len(letters), 64)]
        for group, x in zip(groups, self.library.encode_batch_fast([" ".join(pieces[i] for i in g) for g in groups], add_special_tokens=False), strict=True):
            ids = x.ids
            cuts = [0, *(np.flatnonzero(self.ends[ids]) + 1).tolist()]
            if len(cuts) != len(group) + 1:  # lower case has made marks of some letter
                alone += group
                continue
            for i, lo, hi in zip(group, cuts, cuts[1:], strict=False):
                found[i] = ids[lo:hi]
        for i, x in zip(alone, self.library.encode_batch_fast([pieces[i] for i in alone], add_special_tokens=False), strict=True):
            found[i] = x.ids
        return found

    def _learn(self, pieces: list[str]) -> None:
        found = self._library(pieces)
        lengths = np.fromiter(map(len, found), np.int32, len(found))
        total, first = int(lengths.sum()), len(self.known)
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while first + len(pieces) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        self.ids[self.used : self.used + total] = np.concatenate([np.asarray(x, np.uint16) for x in found]) if total else 0
        self.starts[first : first + len(pieces)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[first : first + len(pieces)] = lengths
        self.used += total
        self.known.update(zip(pieces, range(first, first + len(pieces)), strict=True))

    def _numbers(self, pieces: pa.Array) -> np.ndarray:
        names = pieces.to_pylist()
        if len(self.known) > self.REMEMBERED:
            self._forget()
        if new := [x for x in names if x not in self.known]:
            for i in range(0, len(new), 1 << 14):
                self._learn(new[i : i + (1 << 14)])
        return np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids (uint16) of all texts one after another, and the number of each text's ids.  Null is empty."""
        if not len(texts):
            return np.zeros(0, np.uint16), np.zeros(0, np.int64)
        parts, lengths = zip(*(self._encode(x) for _, x in slices(texts, SLICE)), strict=True)
        return np.concatenate(parts), np.concatenate(lengths)

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts, "")
        cut = pc.split_pattern(self._runs(texts), " ")
        offsets = np.asarray(cut.offsets)
        coded = cut.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        names = coded.dictionary
        stems = pc.utf8_rtrim(names, characters=MARKS)
        plain = pc.match_substring_regex(names, f"^[{LETTERS}]+[{re.escape(MARKS)}]+$" if self.CUT else r"$^x")
        split = np.asarray(plain)
        tails = [x[len(s) :] for x, s in zip(names.filter(plain).to_pylist(), stems.filter(plain).to_pylist(), strict=True)]
        tails = pa.array(tails, pa.large_string())
        heads = pc.if_else(plain, stems, names)
        if self.HEAD:
            heads = pc.binary_join_element_wise(*(pa.scalar(x, pa.large_string()) if isinstance(x, str) else x for x in (self.HEAD, heads.cast(pa.large_string()), "")))
        both = pa.concat_arrays([heads.cast(pa.large_string()), tails]).dictionary_encode()
        number = self._numbers(both.dictionary)[np.asarray(both.indices)] if len(both) else np.zeros(0, np.int64)
        # Each distinct run is one piece or two; write its ids out once.
        per = np.ones(len(names), np.int64) + split
        at = np.zeros(per.sum(), np.int64)
        first = np.cumsum(per) - per
        at[first] = number[: len(names)]
        at[first[split] + 1] = number[len(names) :]
        flat, many = self._gather(at)
        run_length = np.add.reduceat(many, first) if len(first) else np.zeros(0, np.int64)
        run_start = np.cumsum(run_length) - run_length
        use = np.asarray(coded.indices)
        n = run_length[use]
        if self.HEAD:  # a text without any character has no head
            n[(offsets[:-1] - offsets[0])[np.asarray(pc.equal(pc.binary_length(texts), 0))]] = 0
        ids = flat[_ranges(run_start[use], n)]
        ends = np.concatenate([[0], np.cumsum(n)])[offsets - offsets[0]]
        return ids, np.diff(ends)

    def _gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        many = self.lengths[numbers].astype(np.int64)
        return self.ids[_ranges(self.starts[numbers], many)], many


#: A-Z in lower case, ASCII white space as a space; as many bytes as before.
BLANK = bytes.maketrans(bytes(range(9, 14)), b" " * 5)
FOLD = bytes.maketrans(bytes(range(65, 91)) + bytes(range(9, 14)), bytes(range(97, 123)) + b" " * 5)


def slices(texts: pa.Array, most: int) -> Iterator[tuple[int, pa.Array]]:
    """Whole texts, as many as make up about `most` bytes, with the index of the first."""
    sizes, lo = np.asarray(pc.fill_null(pc.binary_length(texts), 0)), 0
    if len(sizes):
        for hi in [*(np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // most)) + 1), len(sizes)]:
            yield lo, texts.slice(lo, hi - lo)
            lo = hi


def _folded(texts: pa.Array) -> pa.Array:
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = (texts.buffers()[2] or pa.py_buffer(b""))[offsets[0] : offsets[-1]].to_pybytes()
    data = data.translate(BLANK if b"<|" in data else FOLD)  # a special token is one in lower case only
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets - offsets[0]), pa.py_buffer(data))


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0] .. starts[0] + lengths[0] - 1, then those of the next."""
    total = int(lengths.sum())
    return np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(total)


@cache
def encoder(name: str = VOCABULARY) -> Encoder:
    return Encoder(name)


def forget() -> None:
    """Frees what this worker remembers, before it does other work."""
    encoder.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
