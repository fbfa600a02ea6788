"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over the pieces runs once over the text; at each position its output links give all
pieces that end there, longest first, and each relaxes the best score of that position (Viterbi in one pass).
Characters that no piece covers become byte pieces. Scores are those of the model file; where these are the ranks of
merges (whole numbers) and no log-probabilities, each piece has that of its rank by the law of Zipf and Mandelbrot, so
that scores of a path may be added.

No path crosses a place between two characters that follow each other in no piece, so a text is cut there and
the paths of its parts are joined; parts, words for the most part, are remembered. Where some piece holds the
space mark after another character, texts aren't cut at spaces first.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import as_bytes, bounded_batches, chunks

SPACE = "▁"
#: Of ranks, in the law of Zipf and Mandelbrot.
SHIFT = 100.0
#: Parts of texts that a Python worker remembers the pieces of, and their longest length.
REMEMBERED, LONGEST = 300_000, 48


class Pieces:
    """An encoder and decoder over (piece, score) lists with byte pieces <0x00> to <0xFF>."""

    def __init__(self, normal: dict[str, tuple[int, float]], byte_ids: list[int], texts: list[bytes], prefix: bool = True):
        self.byte_ids, self.texts, self.prefix = byte_ids, texts, prefix
        self.automaton = ahocorasick.Automaton()
        for piece, (i, score) in normal.items():
            self.automaton.add_word(piece, (len(piece), i, score))
        self.automaton.make_automaton()
        self.single = {p for p in normal if len(p) == 1}
        self.unknown = min(s for _, s in normal.values()) - 10.0
        self.cut = all(SPACE not in p.lstrip(SPACE) for p in normal)
        self.joined = {p[i : i + 2] for p in normal for i in range(len(p) - 1)}
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str, shift: float | None = SHIFT) -> Pieces:
        """shift: of ranks in -log(rank + shift); None takes ranks as they are, too."""
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        normal, byte_ids, texts = {}, [0] * 256, []
        for i in range(m.get_piece_size()):
            p = m.id_to_piece(i)
            if m.is_byte(i):
                byte_ids[int(p[3:5], 16)] = i
                texts.append(bytes([int(p[3:5], 16)]))
            elif m.is_control(i) or m.is_unknown(i) or m.is_unused(i):
                texts.append(b"")
            else:
                normal[p] = (i, m.get_score(i))
                texts.append(p.replace(SPACE, " ").encode())
        if shift is not None and all(s <= 0 and s == int(s) for _, s in normal.values()):
            normal = {p: (i, -math.log(shift - s)) for p, (i, s) in normal.items()}
        return cls(normal, byte_ids, texts)

    def path(self, s: str) -> list[int]:
        """Ids of the best path through s, in which spaces are marks already."""
        n = len(s)
        best, back, ids = [float("-inf")] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        ready = 0  # ends up to here are settled

        def settle(to):
            nonlocal ready
            while ready < to:
                if s[ready] not in self.single and best[ready] + self.unknown > best[ready + 1]:
                    best[ready + 1], back[ready + 1], ids[ready + 1] = best[ready] + self.unknown, ready, -1
                ready += 1

        for last, (size, i, score) in self.automaton.iter(s):
            settle(last)
            start, end = last + 1 - size, last + 1
            if best[start] + score > best[end]:
                best[end], back[end], ids[end] = best[start] + score, start, i
        settle(n)
        out, end = [], n
        while end:
            start = back[end]
            if ids[end] >= 0:
                out.append(ids[end])
            else:
                out.extend(self.byte_ids[b] for b in reversed(s[start:end].encode()))
            end = start
        return out[::-1]

    def _packed(self, s: str) -> bytes:
        joined, at, out = self.joined, 0, []
        cuts = [i for i in range(1, len(s)) if s[i - 1 : i + 1] not in joined]
        if len(self.parts) > REMEMBERED // 2:
            self.parts.clear()
        for end in (*cuts, len(s)):
            part = s[at:end]
            got = self.parts.get(part)
            if got is None:
                got = array("I", self.path(part)).tobytes()
                if len(part) <= LONGEST:
                    self.parts[part] = got
            out.append(got)
            at = end
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not self.cut:
            return self._packed((SPACE if self.prefix else "") + text.replace(" ", SPACE))
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        if self.prefix and SPACE not in text and text[0] != " " and text[-1] != " " and "  " not in text:
            parts = text.split(" ")  # each has one mark before it
            try:
                return b"".join([known[p] for p in parts])
            except KeyError:
                pass
            marked = [(p, SPACE + p) for p in parts]
        else:
            marked = [("\0" + p, p) for p in re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", (SPACE if self.prefix else "") + text.replace(" ", SPACE))]
        out = []
        for key, part in marked:
            got = known.get(key)
            if got is None:
                got = self._packed(part)
                if len(part) <= LONGEST:
                    known[key] = got
            out.append(got)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        texts = self.texts
        out = b"".join([texts[i] for i in memoryview(ids).cast("I")]).decode("utf-8", "replace")
        return out[1:] if self.prefix and out[:1] == " " else out


_LOADED: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    """One automaton for each Python worker, which keeps what it remembers from task to task."""
    if path not in _LOADED:
        _LOADED[path] = Pieces.load(path)
    return _LOADED[path]


def _each(docs: DataFrame, model_path: str, schema: str, row) -> DataFrame:
    names = [f.split()[0] for f in schema.split(", ")]
    bounded_batches(docs.sparkSession)

    def run(batches):
        pieces = pieces_of(model_path)
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), as_bytes(batch.column("text"))
            for a, b in chunks(texts):
                rows = [row(pieces, i, (t or b"").decode()) for i, t in zip(ids[a:b], texts[a:b], strict=True)]
                kinds = {"ids": pa.list_(pa.int32()), "restored": pa.bool_()}
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.int64())) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_pieces, ids for each row; a null or empty text has no pieces, a null doc_id stays null."""

    def row(pieces, i, text):
        ids = np.frombuffer(pieces.encode(text), np.int32)
        return i, len(ids), ids

    return _each(docs, model_path, "doc_id long, n_pieces long, ids array<int>", row)


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_pieces, n_byte_pieces, ids_crc32, n_chars and whether decoding gives the text again.

    A text that holds the space mark itself comes back with a space in its place (restored is false).
    """

    def row(pieces, i, text):
        data = pieces.encode(text)
        ids = np.frombuffer(data, np.uint32)
        low, high = min(pieces.byte_ids), max(pieces.byte_ids)
        return i, len(ids), int(((ids >= low) & (ids <= high)).sum()), zlib.crc32(data), len(text), pieces.decode(data) == text

    return _each(docs, model_path, "doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, n_chars long, restored boolean", row)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, text from doc_id, ids; null ids give a null text."""

    def run(batches):
        pieces = pieces_of(model_path)
        for batch in batches:
            texts = [None if x is None else pieces.decode(struct.pack(f"<{len(x)}I", *x)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
