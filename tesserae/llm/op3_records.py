"""Token ids as length-delimited binary records.

A shard file is a row of frames: length (8 bytes), masked checksum of the length (4), payload, masked checksum
of the payload (4), all little-endian. A payload is the document id (8 bytes), the width of an id in bytes (1)
and the ids. Beside each shard lies an index of (document id, offset, length), 24 bytes for each record, so a
reader can shuffle records without scanning. Checksums are CRC-32, rotated and offset as usual, so that a
checksum of data which holds checksums stays sound.

Texts are encoded where they are read; only the ids are shuffled, by ranges of document ids. Tasks write each
shard under a name of their own and the manifest names the file of the attempt that succeeded, so a lost or
repeated task leaves no half file behind that a reader could see.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import chunks, file_system, work_dir

#: Words that a Python worker remembers the ids of.
REMEMBERED = 1_600_000
#: A run of letters and a run of these marks are never joined by the byte-level BPE; the words are known apart.
_MARKED = re.compile(r"([^\W\d_]+)([,.;:!?%&$*#]+)")
#: The space as byte-level vocabularies write it.
_SPACE = "\u0120"
#: New words encoded in one text, and words whose ids are put together at once.
_TOGETHER, _GATHERED = 200, 1 << 20
_INDEX = "<qqq"


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def unframe(stream) -> bytes | None:
    """The next payload of a stream, or None at its end; raises on a damaged frame."""
    head = stream.read(12)
    if not head:
        return None
    size, check = struct.unpack("<QI", head) if len(head) == 12 else (0, -1)
    if check != masked(head[:8]):
        raise ValueError("damaged length of a record")
    body = stream.read(size + 4)
    if len(body) != size + 4 or struct.unpack("<I", body[-4:])[0] != masked(body[:-4]):
        raise ValueError("damaged record")
    return body[:-4]


class Known:
    """Ids of strings, end to end in one array: a string has a slot, a slot a start and a length."""

    def __init__(self, dtype):
        self.slots: dict[str, int] = {}
        self.ids, self.at, self.n = np.zeros(1 << 16, dtype), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.used = self.count = 0

    def add(self, ids: np.ndarray, n: np.ndarray) -> range:
        """Keeps ids of len(n) strings; their slots."""
        used, count = self.used + len(ids), self.count + len(n)
        if used > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(2 * used - self.used, self.ids.dtype)])
        if count > len(self.at):
            more = np.zeros(2 * count - self.count, np.int64)
            self.at, self.n = np.concatenate([self.at[: self.count], more]), np.concatenate([self.n[: self.count], more])
        self.ids[self.used : used] = ids
        self.at[self.count : count] = self.used + np.cumsum(n) - n
        self.n[self.count : count] = n
        slots = range(self.count, count)
        self.used, self.count = used, count
        return slots

    def of(self, slots: np.ndarray) -> np.ndarray:
        """The ids of slots, end to end."""
        n = self.n[slots]
        ends = np.cumsum(n)
        return self.ids[np.repeat(self.at[slots] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]


class Encoder:
    """Encodes texts with a tokenizers file, remembering the ids of words.

    A byte-level BPE never joins what a single space parts: a token may begin with one space, and longer
    white space is left whole here. So a text is cut before single spaces between other characters, and the
    pieces are encoded once each. A tokenizer of another kind must be encoded with whole=True.

    Arrow cuts the texts and finds their distinct words; only these are looked up one by one. New words are
    encoded many in one text, where a word begins at each token that begins with the space.
    """

    def __init__(self, path: str, whole: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.whole = Tokenizer.from_file(path), whole
        vocabulary = self.tokenizer.get_vocab()
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.opens = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.opens[[i for token, i in vocabulary.items() if token.startswith(_SPACE)]] = True
        self._forget()

    def _forget(self) -> None:
        #: ids of a space and a word; slot -1 for words that don't stand free (empty, white space at an end)
        self.known = Known(self.dtype)
        #: slots of marks alone, in the same array
        self.marks: dict[str, int] = {}

    def _arrays(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _packed(self, texts: list[str]) -> list[bytes]:
        return [a.tobytes() for a in self._arrays(texts)]

    @staticmethod
    def pieces(parts: list[str]) -> list[str]:
        """Pieces of a text with white space of other kinds than single spaces between words."""
        out = [parts[0]]
        for p in parts[1:]:
            last = out[-1]
            if p and last and not p[0].isspace() and not last[-1].isspace():
                out.append(" " + p)
            else:
                out[-1] = f"{last} {p}"
        return out

    def _spaced(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids, end to end, of free words with a space before each, and their numbers."""
        ids, n = [np.zeros(0, self.dtype)], [np.zeros(0, np.int64)]
        groups = [words[i : i + _TOGETHER] for i in range(0, len(words), _TOGETHER)]
        for group, found in zip(groups, self._arrays([" " + " ".join(g) for g in groups]), strict=True):
            starts = np.flatnonzero(self.opens[found])
            if len(starts) == len(group) and starts[0] == 0:
                ids.append(found)
                n.append(np.diff(starts, append=len(found)))
            else:  # a token that takes the space away
                single = self._arrays([" " + w for w in group])
                ids += single
                n.append(np.array([len(a) for a in single], np.int64))
        return np.concatenate(ids), np.concatenate(n)

    def _learn(self, words: list[str]) -> None:
        known, slots = self.known, self.known.slots
        marked = [m for m in map(_MARKED.fullmatch, words) if m]
        plain = set(words).difference([m[0] for m in marked]).union([m[1] for m in marked]).difference(slots)
        free = [w for w in plain if w and not w[0].isspace() and not w[-1].isspace()]
        slots.update(dict.fromkeys(plain, -1))
        slots.update(zip(free, known.add(*self._spaced(free)), strict=True))
        if marks := list({m[2] for m in marked}.difference(self.marks)):
            ids = self._arrays(marks)
            self.marks.update(zip(marks, known.add(np.concatenate(ids), np.array([len(a) for a in ids], np.int64)), strict=True))
        if marked:
            pairs = np.array([(slots[m[1]], self.marks[m[2]]) for m in marked], np.int64)
            slots.update(zip([m[0] for m in marked], known.add(known.of(pairs.ravel()), known.n[pairs].sum(1)), strict=True))

    def _slots(self, words: list[str]) -> np.ndarray:
        slots = self.known.slots
        out = np.fromiter(map(slots.get, words, repeat(-2)), np.int64, len(words))
        new = np.flatnonzero(out == -2)
        if len(new):
            fresh = [words[i] for i in new]
            self._learn(fresh)
            out[new] = np.fromiter(map(slots.__getitem__, fresh), np.int64, len(fresh))
            for w in [w for w in fresh if len(w) > 64]:
                slots.pop(w, None)
                if m := _MARKED.fullmatch(w):
                    slots.pop(m[1], None)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.whole or not texts:
            return self._packed(texts)
        if len(self.known.slots) > REMEMBERED or self.known.used > 8 * REMEMBERED:
            self._forget()
        cut = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        words, bounds = cut.flatten().dictionary_encode(), cut.offsets.to_numpy()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        slots = self._slots(distinct)[words.indices.to_numpy()]
        first, end = bounds[:-1] - bounds[0], bounds[1:] - bounds[0]
        heads = self._packed([distinct[i] for i in words.indices.to_numpy()[first]])
        bad = np.concatenate([[0], np.cumsum(slots < 0)])
        odd = (end - first > 1) & (bad[end] > bad[first])
        out = []
        for head, a, b, whole, text in zip(heads, (first + 1).tolist(), end.tolist(), odd.tolist(), texts, strict=True):
            if whole:
                out.append(b"".join(self._packed(self.pieces(text.split(" ")))))
            else:
                out.append(b"".join([head, *(self.known.of(slots[i : min(b, i + _GATHERED)]).tobytes() for i in range(a, b, _GATHERED))]))
        return out


_ENCODERS: dict = {}


def encoder_of(path: str, whole: bool) -> Encoder:
    """One encoder for each Python worker, which keeps what it remembers from task to task."""
    if (path, whole) not in _ENCODERS:
        _ENCODERS[path, whole] = Encoder(path, whole)
    return _ENCODERS[path, whole]


def _bounds(docs: DataFrame, shards: int) -> np.ndarray:
    """The smallest id of each shard; one number for each shard comes to the driver."""
    parts = docs.repartitionByRange(shards, "k").select(F.spark_partition_id().alias("p"), "k")
    return np.array(sorted(r["m"] for r in parts.groupBy("p").agg(F.min("k").alias("m")).collect()), np.int64)


def write_records(docs: DataFrame, tokenizer_path: str, end_id: int | None = 0, whole: bool = False, shards: int | None = None) -> DataFrame:
    """Writes the shards of docs (doc_id, text); returns shard, path, n_docs, n_tokens, start.

    start is the number of ids in earlier shards; shards follow each other by document id, as do records in
    them (equal ids by content). A null text is an empty one; rows with a null doc_id are left out.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("k"), F.coalesce(F.col("text"), F.lit("")).alias("text")).where("k is not null")
    shards = shards or max(1, rows.rdd.getNumPartitions())
    bounds = spark.sparkContext.broadcast(_bounds(rows.select("k"), shards))
    folder = work_dir(spark, "records")

    def encode(batches):
        encoder = encoder_of(tokenizer_path, whole)
        end = b"" if end_id is None else end_id.to_bytes(encoder.width, "little")
        head = bytes([encoder.width])
        for batch in batches:
            ids, texts = batch.column("k").to_numpy(), batch.column("text")
            shard = np.maximum(np.searchsorted(bounds.value, ids, "right") - 1, 0).astype(np.int32)
            sizes = [b"x" * 0 if t is None else t for t in texts.cast(pa.binary()).to_pylist()]
            for a, b in chunks(sizes):
                data = [head + e + end for e in encoder.encode([t.decode() for t in sizes[a:b]])]
                yield pa.RecordBatch.from_arrays([pa.array(shard[a:b]), pa.array(ids[a:b]), pa.array(data, pa.binary())], ["shard", "k", "ids"])

    def write(batches):
        fs, inner = file_system(folder)
        fs.create_dir(inner, recursive=True)
        out = index = shard = None
        path, at, n_docs, n_ids = "", 0, 0, 0

        def close():
            out.close()
            index.close()
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((shard, pa.int32()), (path, pa.string()), (n_docs, pa.int64()), (n_ids, pa.int64()))], ["shard", "path", "n_docs", "n_tokens"])

        for batch in batches:
            for s, k, ids in zip(*(batch.column(c).to_pylist() for c in ("shard", "k", "ids")), strict=True):
                if s != shard:
                    if out:
                        yield close()
                    name = f"{s:08d}-{uuid.uuid4().hex}"
                    shard, path, at, n_docs, n_ids = s, f"{folder}/{name}", 0, 0, 0
                    out, index = fs.open_output_stream(f"{inner}/{name}.rec"), fs.open_output_stream(f"{inner}/{name}.idx")
                record = frame(struct.pack("<q", k) + ids)
                out.write(record)
                index.write(struct.pack(_INDEX, k, at, len(record)))
                at, n_docs, n_ids = at + len(record), n_docs + 1, n_ids + (len(ids) - 1) // ids[0]
        if out:
            yield close()

    encoded = rows.mapInArrow(encode, "shard int, k long, ids binary").repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "k", "ids")
    written = sorted(encoded.mapInArrow(write, "shard int, path string, n_docs long, n_tokens long").collect(), key=lambda r: r["shard"])
    start, manifest = 0, []
    for r in written:  # a row for each shard
        manifest.append((*r, start))
        start += r["n_tokens"]
    return spark.createDataFrame(manifest, "shard int, path string, n_docs long, n_tokens long, start long")


def ids_of(payload: bytes) -> tuple[int, np.ndarray]:
    """Document id and token ids of a payload."""
    return struct.unpack_from("<q", payload)[0], np.frombuffer(payload, "<u2" if payload[8] == 2 else "<u4", offset=9)


def read_shard(path: str) -> Iterator[tuple[int, np.ndarray]]:
    fs, inner = file_system(path)
    with fs.open_input_stream(inner + ".rec", buffer_size=1 << 20) as stream:
        while (payload := unframe(stream)) is not None:
            yield ids_of(payload)


def read_record(path: str, n: int) -> tuple[int, np.ndarray]:
    """The n-th record of a shard by its index alone."""
    fs, inner = file_system(path)
    with fs.open_input_file(inner + ".idx") as index, fs.open_input_file(inner + ".rec") as records:
        index.seek(n * struct.calcsize(_INDEX))
        _, offset, _ = struct.unpack(_INDEX, index.read(struct.calcsize(_INDEX)))
        records.seek(offset)
        return ids_of(unframe(records))


def read_records(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of all records, read back from the shard files."""

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                rows = []
                for k, ids in read_shard(path):
                    rows.append((k, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) == 5000:
                        yield pack(rows)
                        rows = []
                if rows:
                    yield pack(rows)

    def pack(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    shards = max(1, manifest.count())
    return manifest.select("shard", "path", "start").repartitionById(shards, F.col("shard")).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
