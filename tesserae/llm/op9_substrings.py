"""Substring dedup by seed and extend on winnowed anchors.

A window is `width` consecutive words. Its five-word runs are hashed and the smallest hash is its anchor
(winnowing: equal windows have equal anchors, so no repeat of `width` words goes without a common anchor).
1. Documents are joined on anchors: each scan partition sends the anchors of its windows with the smallest
   document that has them, and gets back those that other documents have too.
2. Matches are extended both ways from shared anchors, to the whole windows that hold them. Not word by word for each
   pair of documents, as seed and extend does as a rule: a passage in a third of all documents would be all pairs of
   them. Instead each window around a shared anchor is sent once by a partition as a 128-bit hash, and each one that
   starts in a smaller document comes back. What the pairs would find is the same, but for chance equality of hashes.
3. Adjoining windows found repeated merge into maximal repeats, whose words are removed.
Each anchor or window is sent once by a partition, so a passage in a third of all documents costs one row for
each partition and no pair of documents is ever made. Texts are scanned three times and never shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import Numbered, Words, as_bytes, chunks, grams, write_side

SEED = 5
_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
#: Anchors or windows that a task holds before it sends them on; sorting them takes some 100 bytes each.
HELD = 1_500_000


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """The minimum of each n consecutive values."""
    out, span = x, 1
    while 2 * span <= n:
        out, span = np.minimum(out[:-span], out[span:]), 2 * span
    rest = n - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _windows(texts, width):
    """For the texts: words, the number of each window's first word, its anchor."""
    words = Words(texts)
    n = len(words.starts) - width + 1
    if n <= 0:
        return words, None, np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = words.hashes(0)
    anchors = _least(grams(hashes, SEED), width - SEED + 1)
    at = np.flatnonzero(words.owner[:n] == words.owner[width - 1 :])
    return words, hashes, at, anchors[at]


def _firsts(keys: tuple[np.ndarray, ...], docs: np.ndarray):
    """Distinct keys with the smallest document and whether there is another one."""
    order = np.lexsort((docs, *keys[::-1]))
    keys, docs = [k[order] for k in keys], docs[order]
    new = np.ones(len(docs), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    start = np.flatnonzero(new)
    last = np.append(start[1:], len(docs)) - 1
    return [k[start] for k in keys], docs[start], docs[last]


def _sender(find, names: list[str]):
    """A scan step that sends what find(ids, texts, side) yields, keys with the least and the greatest document."""

    def flush(pid, held):
        keys, low, high = ([np.concatenate([h[i] for h in held]) for i in range(len(names))], *(np.concatenate([h[i] for h in held]) for i in (-2, -1)))
        order = np.lexsort(keys[::-1])
        keys, low, high = [k[order] for k in keys], low[order], high[order]
        new = np.ones(len(low), bool)
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        start = np.flatnonzero(new)
        low, high = np.minimum.reduceat(low, start), np.maximum.reduceat(high, start)
        for i in range(0, len(start), 100_000):
            part = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(low[part]), pid, np.int32)), *(pa.array(k[start][part].view(np.int64)) for k in keys), pa.array(low[part]), pa.array(high[part])],
                ["pid", *names, "low", "high"],
            )

    def step(pid, batches, side):
        held, n = [], 0
        for batch in batches:
            ids, texts = batch.column("k").to_pylist(), as_bytes(batch.column("text"))
            texts = [None if i is None else t for i, t in zip(ids, texts, strict=True)]
            ids = np.array([i or 0 for i in ids], np.int64)
            for a, b in chunks(texts):
                keys, docs = find(ids[a:b], texts[a:b], side)
                if len(docs):
                    keys, low, high = _firsts(keys, docs)
                    held.append((*keys, low, high))
                    n += len(low)
                if n > HELD:
                    yield from flush(pid, held)
                    held, n = [], 0
        if held:
            yield from flush(pid, held)

    return step


def _lookup(side, names):
    """Side rows as arrays sorted by the first column."""
    table = side(*names) if side else None
    if table is None or not table.num_rows:
        return None
    columns = [table.column(x).to_numpy() for x in names]
    columns[:-1] = [c.view(np.uint64) for c in columns[:-1]]
    order = np.lexsort(columns[-2::-1])
    return [c[order] for c in columns]


def _known(found, values: np.ndarray) -> np.ndarray:
    at = np.searchsorted(found[0], values)
    at[at == len(found[0])] = 0
    return found[0][at] == values


def repeats(docs: DataFrame, width: int = 13) -> tuple[Numbered, str]:
    """The numbered scan of docs and the side table of windows (h, g) that start in a smaller document `least`."""
    if width < SEED:
        raise ValueError(f"width must be {SEED} at least")
    scan = Numbered(docs, "doc_id")

    def find_anchors(ids, texts, _):
        words, _, at, anchors = _windows(texts, width)
        return (anchors,), ids[words.owner[at]]

    sent = scan.scan(_sender(find_anchors, ["h"]), "pid int, h long, low long, high long", ["text"])
    same = Window.partitionBy("h")
    # as many tasks as the scan has, each with about the share of a scan partition
    shared = (
        sent.repartition(scan.partitions, "h").withColumns({"least": F.min("low").over(same), "most": F.max("high").over(same)})
        .where("least < most")
    )
    anchors = write_side(shared.select("pid", "h", "least"), "anchors", scan)

    def find_windows(ids, texts, side):
        if "found" not in cache:
            cache["found"] = _lookup(side, ["h", "least"])
        found, none = cache["found"], (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
        words, hashes, at, own = _windows(texts, width)
        if found is None or not len(at):
            return none, np.zeros(0, np.int64)
        at = at[_known(found, own)]
        if not len(at):
            return none, np.zeros(0, np.int64)
        return (grams(hashes, width)[at], grams(words.hashes(1), width, 1)[at]), ids[words.owner[at]]

    cache: dict = {}
    inner = _sender(find_windows, ["h", "g"])

    def windows_step(pid, batches, side):
        cache.clear()
        yield from inner(pid, batches, side)

    sent = scan.scan(windows_step, "pid int, h long, g long, low long, high long", ["text"], anchors)
    same = Window.partitionBy("h", "g")
    again = sent.repartition(scan.partitions, "h").withColumn("least", F.min("low").over(same)).where("high > least").select("pid", "h", "g", "least")
    return scan, write_side(again, "windows", scan)


def _covered(texts, ids, found, width):
    """Words of the texts, and which of them lie in a window that starts in a smaller document."""
    words, hashes, at, _ = _windows(texts, width)
    gone = np.zeros(len(words.starts) + 1, np.int64)
    if found is not None and len(at):
        h = grams(hashes, width)
        at = at[_known(found, h[at])]
        if len(at):
            pairs = np.searchsorted(found[0], h[at])
            g, owner = grams(words.hashes(1), width, 1)[at], ids[words.owner[at]]
            hit, open_ = np.zeros(len(at), bool), np.ones(len(at), bool)
            while open_.any():  # windows of one first hash lie together; almost always one
                here = np.minimum(pairs, len(found[0]) - 1)
                open_ &= (pairs < len(found[0])) & (found[0][here] == h[at])
                hit |= open_ & (found[1][here] == g) & (found[2][here] < owner)
                pairs = pairs + 1
            np.add.at(gone, at[hit], 1)
            np.add.at(gone, np.minimum(at[hit] + width, len(gone) - 1), -1)
    return words, np.cumsum(gone)[:-1] > 0


def _kept_text(words: Words, gone: np.ndarray, a: int, b: int) -> bytes:
    """Kept words of one text, joined by one space."""
    own = words.joined[words.starts[a] : words.ends[b - 1]] if b > a else b""
    parts = own.split()
    if gone[a:b].any():
        parts = [w for w, g in zip(parts, gone[a:b].tolist(), strict=True) if not g]
    return b" ".join(parts)


def dedup_substrings(docs: DataFrame, width: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: words outside all repeats of `width` words of smaller documents.

    Null, empty and short texts have no windows and lose nothing (no words: the digest of an empty text).
    Rows with a null doc_id are left out; rows with one doc_id count as one document, so none removes
    words of another. Windows are judged on the input.
    """
    scan, side_path = repeats(docs, width)

    def step(pid, batches, side):
        found = _lookup(side, ["h", "g", "least"])
        for batch in batches:
            keep = batch.column("k").is_valid()
            batch = batch.filter(keep)
            ids, texts = batch.column("k").to_numpy(zero_copy_only=False), as_bytes(batch.column("text"))
            n_words, n_gone, digests = [], [], []
            for a, b in chunks(texts):
                words, gone = _covered(texts[a:b], ids[a:b], found, width)
                for i, j in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
                    n_words.append(j - i)
                    n_gone.append(int(gone[i:j].sum()))
                    digests.append(hashlib.sha256(_kept_text(words, gone, i, j)).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return scan.scan(step, _RESULT, ["text"], side_path)


def remove_repeats(docs: DataFrame, width: int = 13) -> DataFrame:
    """docs with repeated passages taken out of `text`; a text left without a word goes, unless it had none.

    Texts without a repeat stay byte for byte; from others the words of repeats are removed together with the
    white space before them. All columns come through; n_chars, where it is one of them, is counted anew.
    """
    scan, side_path = repeats(docs, width)
    schema = docs.schema
    counted = "n_chars" in schema.names

    def step(pid, batches, side):
        found = _lookup(side, ["h", "g", "least"])
        for batch in batches:
            rows = pa.RecordBatch.from_struct_array(batch.column("row"))
            ids = batch.column("k").to_pylist()
            texts = as_bytes(rows.column("text"))
            new, keep = list(texts), [True] * len(texts)
            for a, b in chunks(texts):
                known = [None if i is None else t for i, t in zip(ids[a:b], texts[a:b], strict=True)]
                words, gone = _covered(known, np.array([i or 0 for i in ids[a:b]], np.int64), found, width)
                for n, (i, j) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
                    if gone[i:j].any():
                        base, runs = int(words.offsets[n]), []
                        edges = np.flatnonzero(np.diff(np.concatenate([[1], gone[i:j].view(np.int8), [1]])))
                        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                            runs.append(words.joined[(words.ends[i + s - 1] if s else base) : words.ends[i + e - 1]])
                        new[a + n], keep[a + n] = b"".join(runs).lstrip() if gone[i] else b"".join(runs), bool(runs)
            columns = {f: rows.column(f) for f in rows.schema.names}
            columns["text"] = pa.array([t if t is None else t.decode() for t in new], rows.schema.field("text").type)
            if counted:
                old = rows.column("n_chars").to_pylist()
                columns["n_chars"] = pa.array([o if t is u else len(u.decode()) for o, t, u in zip(old, texts, new, strict=True)], rows.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns)).filter(pa.array(keep))

    return scan.scan(step, schema, None, side_path)
