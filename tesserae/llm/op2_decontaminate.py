"""Benchmark decontamination by Wu-Manber search over words.

Test strings are windows of an item's words. For each length of windows, a shift table says for every block of
two words (by its hash) how far the search may jump; where it says 0, the block may end a test string, the bucket of
that suffix holds those strings, and direct comparison of the words confirms.

Tables are numpy arrays: some 20 bytes for each byte of benchmark text. A Python worker keeps one set of them at a time.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import Numbered, Words, as_bytes, chunks, grams, write_side

#: Separators become spaces and A-Z small letters; all bytes of 0x80 and over belong to words.
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))

#: Bytes of benchmark text that one broadcast holds; a larger benchmark is searched for in several scans.
SLICE_BYTES = 4 << 20

_SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def words_of(texts: list[bytes | None]) -> Words:
    return Words([t.translate(_TABLE) if t else t for t in texts])


def _slice(words: Words, a: int, b: int) -> list[bytes]:
    return words.joined[words.starts[a] : words.ends[b - 1]].split()


class _Table:
    """Shifts and buckets of the windows of m words that start at the given words of all items."""

    def __init__(self, words: Words, hashes: np.ndarray, m: int, starts: np.ndarray):
        self.m, self.block = m, min(2, m)
        blocks = grams(hashes, self.block)
        self.bits = np.uint64(64 - max(16, int(np.ceil(np.log2(8 * m * len(starts))))))
        jump = m - self.block + 1
        self.shift = np.full(1 << (64 - int(self.bits)), jump, np.uint8)
        for end in range(self.block, m + 1):  # the smallest shift of a block comes last
            self.shift[(blocks[starts + end - self.block] >> self.bits).astype(np.int64)] = m - end
        suffix, whole = blocks[starts + m - self.block], grams(hashes, m)[starts]
        order = np.lexsort((starts, whole, suffix))
        self.suffix, self.whole, self.starts = suffix[order], whole[order], starts[order]

    def occurrences(self, words: Words, hashes: np.ndarray, items: Words):
        """(first word, item number) of each occurrence of a window."""
        m, block = self.m, self.block
        if len(hashes) < m:
            return
        blocks = grams(hashes, block)
        shifts = self.shift[(blocks >> self.bits).astype(np.int64)].tobytes()
        end, n, ends = m, len(hashes), []
        while end <= n:
            if s := shifts[end - block]:
                end += s
            else:
                ends.append(end)
                end += 1
        ends = np.array(ends, np.int64)
        ends = ends[words.owner[ends - m] == words.owner[ends - 1]]
        suffix, whole = blocks[ends - block], grams(hashes, m)[ends - m]
        low, high = np.searchsorted(self.suffix, suffix, "left"), np.searchsorted(self.suffix, suffix, "right")
        for i in np.flatnonzero(low < high).tolist():
            bucket = self.whole[low[i] : high[i]]
            at = low[i] + int(np.searchsorted(bucket, whole[i]))
            first, own = int(ends[i]) - m, None
            while at < high[i] and self.whole[at] == whole[i]:
                own = own or _slice(words, first, first + m)
                start = int(self.starts[at])
                if _slice(items, start, start + m) == own:
                    yield first, int(items.owner[start])
                at += 1


class Searcher:
    """Shift tables and suffix buckets of all windows of some items (name, text)."""

    def __init__(self, items: list[tuple[str, bytes]], width: int = 10):
        self.names = [name for name, _ in items]
        self.words = words = words_of([text for _, text in items])
        hashes, sizes = words.hashes(), np.diff(words.first)
        place = np.arange(len(words.owner)) - words.first[:-1][words.owner]
        length = np.minimum(sizes, width)[words.owner]  # of the windows of each word's item
        fits = place + length <= sizes[words.owner]
        self.tables = [_Table(words, hashes, int(m), np.flatnonzero(fits & (length == m))) for m in np.unique(length)]

    def search(self, texts: list[bytes | None]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
        """For each text: its words, merged ranges of hit words of all occurrences, and the items they belong to."""
        words = words_of(texts)
        hashes = words.hashes()
        found: dict[int, tuple[list, set]] = {}
        for table in self.tables:
            for first, item in table.occurrences(words, hashes, self.words):
                text = int(words.owner[first])
                ranges, names = found.setdefault(text, ([], set()))
                at = first - int(words.first[text])
                if not ranges or ranges[-1][0] != at:
                    ranges.append((at, at + table.m))
                names.add(self.names[item])
        sizes = np.diff(words.first).tolist()
        return [(n, merged(found[i][0]), found[i][1]) if i in found else (n, [], set()) for i, n in enumerate(sizes)]


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _slices(benchmark: DataFrame, limit: int) -> list[list[tuple[str, bytes]]]:
    """Items in slices of at most about `limit` bytes, read one after the other."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item"), "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // limit))
    for i in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item"), F.lit(n)) == i)
        yield [(r["item"], r["text"].encode()) for r in part.collect()]


_LAST: dict[tuple, Searcher] = {}


def searcher_of(name: str, shared, width: int) -> Searcher:
    """The Searcher of a broadcast slice, which a Python worker keeps until it meets another slice."""
    if (name, width) not in _LAST:
        _LAST.clear()
        _LAST[name, width] = Searcher(shared.value, width)
    return _LAST[name, width]


def search_documents(docs: DataFrame, benchmark: DataFrame, width: int = 10, limit: int = SLICE_BYTES) -> DataFrame:
    """pid, pos, doc_id, n_words, ranges (start, end pairs of hit words), items for each document and slice."""
    scan = docs if isinstance(docs, Numbered) else Numbered(docs, "doc_id")
    parts = []
    for items in _slices(benchmark, limit):
        shared, name = scan.spark.sparkContext.broadcast(items), uuid.uuid4().hex

        def step(pid, batches, _, shared=shared, name=name):
            searcher, pos = searcher_of(name, shared, width), 0
            for batch in batches:
                rows, ids, texts = [], batch.column("k").to_pylist(), as_bytes(batch.column("text"))
                for a, b in chunks(texts):
                    for i, (n, ranges, names) in zip(ids[a:b], searcher.search(texts[a:b]), strict=True):
                        rows.append((pid, pos, i, n, [x for r in ranges for x in r], sorted(names)))
                        pos += 1
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["pid", "pos", "doc_id", "n_words", "ranges", "items"])

        parts.append(scan.scan(step, "pid int, pos long, doc_id long, n_words long, ranges array<long>, items array<string>", ["text"]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if len(parts) > 1:
        out = out.groupBy("pid", "pos", "doc_id", "n_words").agg(F.flatten(F.collect_list("ranges")).alias("ranges"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, limit: int = SLICE_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each document.

    Null and empty texts have no words; an item without words has no window; items with a null id or text
    take no part; rows with a null doc_id are left out; repeated rows each get their row.
    """

    def run(batches):
        for batch in batches:
            out = []
            for i, n, r, names in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_words", "ranges", "items")), strict=True):
                hit = sum(b - a for a, b in merged(list(zip(r[::2], r[1::2], strict=True))))
                out.append((i, n, hit, len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), hit > 0))
            if out:
                kinds = [pa.int64()] * 4 + [pa.string(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return search_documents(docs, benchmark, width, limit).where("doc_id is not null").select("doc_id", "n_words", "ranges", "items").mapInArrow(run, _SCHEMA)


def keep_clean(docs: DataFrame, benchmark: DataFrame, width: int = 10, limit: int = SLICE_BYTES) -> DataFrame:
    """docs without those that hold a window of a benchmark item; all columns come through."""
    scan = Numbered(docs, "doc_id")
    side = write_side(search_documents(scan, benchmark, width, limit).where("size(items) > 0").select("pid", "pos"), "contaminated", scan)

    def step(pid, batches, side):
        table = side("pos")
        bad = set(table.column("pos").to_pylist()) if table else set()
        pos = 0
        for batch in batches:
            keep = pa.array([pos + i not in bad for i in range(batch.num_rows)], pa.bool_())
            pos += batch.num_rows
            yield pa.RecordBatch.from_struct_array(batch.column("row")).filter(keep)

    return scan.scan(step, docs.schema, None, side)
