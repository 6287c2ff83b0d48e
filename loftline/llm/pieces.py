"""SentencePiece encoding and decoding by a streaming Viterbi search.

The vocabulary is a byte-pair one: a segmentation is the right one if and only if each pair of neighbouring pieces is
what merging would make of the two together.  So for each place of a text just one piece can end the segmentation of
what comes before, and it is found from the places before it: a Viterbi recursion whose transitions are allowed or not.
Only places within the longest piece of the end can still be left by a piece to come.  The search keeps a window of
that length and commits ids as soon as the paths back from all those places meet in one boundary.  Where no piece
holds two neighbouring characters they meet at once; runs between such places are remembered, as most words recur.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of
from .words import MARKS, Encoder, _ranges, slices

VOCABULARY = "piece_bpe_32k.model"
SPACE = "▁"


class Vocabulary:
    """Pieces and scores of a model file."""

    #: Answers about neighbouring pieces that are remembered.
    REMEMBERED = 250_000

    def __init__(self, name: str = VOCABULARY):
        model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        n = model.get_piece_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(n)]
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.ids = {x: i for i, (x, s) in enumerate(zip(self.pieces, special, strict=True)) if not s}
        self.scores = {x: model.get_score(i) for x, i in self.ids.items()}
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(map(len, self.ids))
        self.joined = {x[k : k + 2] for x in self.ids for k in range(len(x) - 1)}
        self.known: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """Merging by rank, the leftmost first; for short strings."""
        parts, score = list(text), self.scores.get
        gains = [score(a + b) for a, b in zip(parts, parts[1:], strict=False)]
        while found := [x for x in gains if x is not None]:
            i = gains.index(max(found))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del gains[i]
            if i:
                gains[i - 1] = score(parts[i - 1] + parts[i])
            if i < len(gains):
                gains[i] = score(parts[i] + parts[i + 1])
        return parts

    def fits(self, before: str, piece: str) -> bool:
        """Whether piece may follow before; with nothing before: whether it is a piece at all."""
        found = self.known.get((before, piece))
        if found is None:
            if len(self.known) > self.REMEMBERED:
                self.known.clear()
            found = self.known[before, piece] = self.merged(before + piece) == ([before, piece] if before else [piece])
        return found

    def ids_of(self, piece: str) -> list[int]:
        i = self.ids.get(piece)
        return [i] if i is not None else [self.bytes[b] for b in piece.encode()]


class Stream:
    """Encodes a text that comes in parts; holds no more than two windows of it."""

    def __init__(self, vocabulary: Vocabulary):
        self.of, self.before = vocabulary, ""
        self.text, self.start, self.last = "", [0], [""]  # what isn't committed; for each place the piece that ends there

    def feed(self, part: str) -> list[int]:
        out, v = [], self.of
        ids, known, joined, longest = v.ids, v.known, v.joined, v.longest
        for c in part:
            if self.text and self.text[-1] + c not in joined:
                out += self.finish()
            text = self.text = self.text + c
            end, last = len(text), self.last
            for j in range(max(0, end - longest), end):
                piece = text[j:]
                if piece in ids or j == end - 1:
                    key = (last[j] if j else self.before, piece)
                    if known[key] if key in known else v.fits(*key):
                        self.start.append(j)
                        last.append(piece)
                        break
            if end >= 2 * longest:
                out += self._commit()
        return out

    def _path(self, end: int) -> list[str]:
        found = []
        while end:
            found.append(self.last[end])
            end = self.start[end]
        return found[::-1]

    def _commit(self) -> list[int]:
        alive = set(range(len(self.text) - self.of.longest + 1, len(self.text) + 1))
        while len(alive) > 1:  # the furthest place goes one piece back
            far = max(alive)
            alive.remove(far)
            alive.add(self.start[far])
        return self._take(alive.pop())

    def _take(self, place: int) -> list[int]:
        path = self._path(place)
        if place:
            self.before = path[-1]
            self.text = self.text[place:]
            self.start = [max(0, s - place) for s in self.start[place:]]
            self.last = ["", *self.last[place + 1 :]]
        return [i for piece in path for i in self.of.ids_of(piece)]

    def finish(self) -> list[int]:
        ids, end, found = self.of.ids, len(self.text), []
        while end:
            found.append(self.last[end])
            end = self.start[end]
        self.text, self.start, self.last, self.before = "", [0], [""], ""
        return [i for piece in reversed(found) for i in ([ids[piece]] if piece in ids else self.of.ids_of(piece))]


@cache
def vocabulary(name: str = VOCABULARY) -> Vocabulary:
    return Vocabulary(name)


class PieceEncoder(Encoder):
    """Whole texts of Arrow batches; runs between spaces are remembered."""

    HEAD = SPACE
    REMEMBERED = 650_000

    def __init__(self, name: str = VOCABULARY):
        self.of = vocabulary(name)
        self.CUT = not any(a.isalpha() and b in MARKS for a, b in self.of.joined)
        self._forget()

    def _library(self, pieces: list[str]) -> list[list[int]]:
        stream = Stream(self.of)
        return [stream.feed(x) + stream.finish() for x in pieces]

    def _runs(self, texts: pa.Array) -> pa.Array:
        # A space after a space, or at the start, belongs to the run after it; the mark for spaces is one itself.
        texts = texts.cast(pa.large_string())
        if not pc.any(pc.match_substring_regex(texts, f"^ |  |{SPACE}")).as_py():
            return texts
        return pa.array([re.sub(r"(?<= ) |\A ", SPACE, x.replace(SPACE, " ")) for x in texts.to_pylist()], pa.large_string())


@cache
def piece_encoder(name: str = VOCABULARY) -> PieceEncoder:
    return PieceEncoder(name)


def _encoded(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, n = piece_encoder(name).encode(b["text"])
        offsets = np.concatenate([[0], np.cumsum(2 * n)]).astype(np.int64)
        data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<u2"))])
        wide, ends = ids.astype("<u4").tobytes(), 4 * np.cumsum(n)
        crc = [zlib.crc32(memoryview(wide)[z - 4 * k : z]) for k, z in zip(n.tolist(), ends.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b["doc_id"], data.cast(pa.binary()), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "ids", "n_ids", "ids_crc32"])


@cache
def _spelling(name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    of = vocabulary(name)
    byte = {i: bytes([b]) for b, i in enumerate(of.bytes)}
    parts = [byte.get(i, x.replace(SPACE, " ").encode() if x in of.ids else b"") for i, x in enumerate(of.pieces)]
    sizes = np.array(list(map(len, parts)), np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(sizes) - sizes, sizes


def _decoded(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    letters, starts, sizes = _spelling(name)
    for b in batches:
        for lo, part in slices(b["ids"], 1 << 22):
            ids = [np.frombuffer(x.as_buffer(), "<u2") for x in part]
            flat = np.concatenate(ids).astype(np.int64)
            data = letters[_ranges(starts[flat], sizes[flat])].tobytes()
            ends = np.concatenate([[0], np.cumsum(sizes[flat])])[np.concatenate([[0], np.cumsum(list(map(len, ids)))])].tolist()
            texts = [data[a:z][1:].decode("utf-8", "replace") for a, z in zip(ends, ends[1:], strict=False)]  # without the space put before
            yield pa.RecordBatch.from_arrays([*(b[c].slice(lo, len(part)) for c in ("doc_id", "n_ids", "ids_crc32")), pa.array(texts, pa.string())], ["doc_id", "n_ids", "ids_crc32", "text"])


def encode_pieces(docs: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """One row for each row of docs: doc_id, ids (16-bit little-endian), n_ids, ids_crc32 (of them as 32-bit integers).

    Whole texts; a null or empty text has no ids.  Characters outside the vocabulary are written as bytes.  Repeated
    rows are repeated.  docs needs doc_id and text; other columns are ignored.  An empty table gives no row.
    """
    rows = docs.select("doc_id", text_of(docs).alias("text"))
    return rows.mapInArrow(partial(_encoded, name=name), "doc_id long, ids binary, n_ids long, ids_crc32 long")


def decode_pieces(encoded: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """doc_id, n_ids, ids_crc32 and the text of the ids: the encoded one, but for U+2581, which is a space then.

    No ids are an empty text, so a null one comes back empty.  Repeated rows are repeated.  An empty table gives no row.
    """
    return encoded.mapInArrow(partial(_decoded, name=name), "doc_id long, n_ids long, ids_crc32 long, text string")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = decode_pieces(encode_pieces(table(spark, sf_dir, "documents")))
    return read.select("doc_id", "n_ids", "ids_crc32", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))
