"""Language ID with bit-sliced Bloom filters.

A filter position holds a bit mask with one bit for each language, so one probe of an n-gram asks all
languages at once: the masks at its positions, ANDed, name all languages that contain it. For each language
the n-grams with its bit are counted, the count is corrected for the filter's known rate of false positives,
and the greatest share decides. n-grams are four bytes of small letters with single spaces between words.

A language's filter holds all n-grams that are about as frequent there as in any other language at least; they are
counted on all documents that may teach. The filter's size follows the number of n-grams, which nears that of the
four-byte pieces of a language's words and doesn't grow with the documents for ever.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import CHUNK_BYTES, as_bytes, bounded_batches, discard, stored

_LETTERS = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
PROBES = 3
PLANE = 64
#: n-grams of all languages that a counting task holds before it passes their counts on, and those in one batch of counts.
HELD, PASSED = 1 << 21, 1 << 16
#: The bits of a double from 0 to 1, as a number, and how many of them one look at all scores settles.
SCORE_BITS, STEP = 62, 10


def plain(text: bytes) -> bytes:
    words = text.decode().lower().encode().translate(_LETTERS).split()
    return b" " + b" ".join(words) + b" " if words else b""


def has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode()) if text.upper() == text.lower() else True


def codes(data: bytes) -> np.ndarray:
    """Each four bytes as one integer."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    return b[:-3] | b[1:-2] << 8 | b[2:-1] << 16 | b[3:] << 24 if len(b) > 3 else np.zeros(0, np.uint32)


def positions(grams: np.ndarray, bits: int) -> list[np.ndarray]:
    h = grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    mask = np.uint64((1 << bits) - 1)
    return [(h >> np.uint64(64 - bits - i * (64 - bits) // PROBES)) & mask for i in range(PROBES)]


@dataclass
class Model:
    languages: list[str]
    bits: int
    planes: list[np.ndarray]  # of up to 64 languages each
    false_rate: np.ndarray

    @classmethod
    def build(cls, features: dict[str, np.ndarray], bits: int | None = None) -> Model:
        """bits: of a position; if None, so that a language has ten positions or more for each of its n-grams."""
        languages = sorted(features)
        bits = bits or max(20, int(np.ceil(np.log2(10 * max([1, *map(len, features.values())])))))
        planes = [np.zeros(1 << bits, np.uint64) for _ in range(-(-len(languages) // PLANE))]
        rates = []
        for n, lang in enumerate(languages):
            plane, bit = planes[n // PLANE], np.uint64(1 << n % PLANE)
            for p in positions(features[lang], bits):
                np.bitwise_or.at(plane, p.astype(np.int64), bit)
            rates.append((((plane & bit) != 0).mean()) ** PROBES)
        return cls(languages, bits, planes, np.array(rates))

    def shares(self, data: bytes) -> np.ndarray:
        """For each language the corrected share of the text's n-grams that it contains."""
        at = positions(codes(data), self.bits)
        n, counts = len(at[0]), []
        for k, plane in enumerate(self.planes):
            masks = plane[at[0]]
            for p in at[1:]:
                masks &= plane[p]
            here = len(self.languages[k * PLANE : (k + 1) * PLANE])
            counts += [int(np.count_nonzero(masks & np.uint64(1 << i))) for i in range(here)]
        raw = np.array(counts) / max(1, n)
        return np.clip((raw - self.false_rate) / (1 - self.false_rate), 0, 1)

    def ranked(self, text: bytes | None) -> tuple[str, float, int]:
        """Language, score and number of n-grams."""
        if not text or not self.languages or not has_letter(text):
            return "und", 0.0, 0
        data = plain(text) or b" " + text
        shares = self.shares(data)
        best = int(np.argmax(shares))
        return self.languages[best], float(shares[best]), len(data) - 3

    def predict(self, text: bytes | None) -> tuple[str, float]:
        return self.ranked(text)[:2]


def _sampled(rows: DataFrame, sample: int) -> set[int]:
    """Ids of the `sample` documents of each language (columns doc_id, lang) with the smallest hashes.

    A language may hold most of all rows, so only those under a bound that some four times `sample` pass are ordered."""
    h = F.xxhash64("doc_id")
    counted = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))  # one row a language
    under = rows.select("doc_id", "lang").withColumn("h", h).join(F.broadcast(counted), "lang").where(F.col("h") / 2.0**64 + 0.5 <= 4.0 * sample / F.col("rows"))
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    picked = under.withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample)
    return {r["doc_id"] for r in picked.select("doc_id").collect()}  # sample * languages at most


def train(docs: DataFrame, sample: int | None = None, bits: int | None = None) -> Model:
    """A model of the non-null languages of docs, from all documents with crc32(doc_id) mod 3 other than 1.

    Only if the caller names a `sample` are so many documents of each language read at most, chosen by hash of their
    id. Rows with a null doc_id, lang or text teach nothing.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").where("doc_id is not null and lang is not null and crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1")
    ids = None if sample is None else spark.sparkContext.broadcast(_sampled(rows, sample))

    def passed(found):
        for lang, (g, c) in found.items():
            for a in range(0, len(g), PASSED):
                part = g[a : a + PASSED]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part.astype(np.int64)), pa.array(c[a : a + PASSED].astype(np.int64))], ["lang", "g", "c"])

    def add(found, pending):
        for lang, parts in pending.items():
            g, c = np.unique(np.concatenate(parts), return_counts=True)
            if lang in found:
                g, at = np.unique(np.concatenate([found[lang][0], g]), return_inverse=True)
                c = np.bincount(at, np.concatenate([found[lang][1], c])).astype(np.int64)
            found[lang] = g, c

    def count(batches):
        found: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        pending: dict[str, list[np.ndarray]] = {}
        size = 0
        for batch in batches:
            for i, lang, t in zip(batch.column("doc_id").to_pylist(), batch.column("lang").to_pylist(), as_bytes(batch.column("text")), strict=True):
                if t and (ids is None or i in ids.value):
                    pending.setdefault(lang, []).append(codes(plain(t)))
                    size += len(t)
                if size >= CHUNK_BYTES:
                    add(found, pending)
                    pending, size = {}, 0
                    if sum(len(g) for g, _ in found.values()) > HELD:
                        yield from passed(found)
                        found = {}
        add(found, pending)
        yield from passed(found)

    counted = rows.mapInArrow(count, "lang string, g long, c long").groupBy("lang", "g").agg(F.sum("c").alias("c"))
    counted = stored(counted, "ngrams")
    totals = counted.groupBy("lang").agg(F.sum("c").alias("total"))  # one row a language
    rated = counted.join(F.broadcast(totals), "lang").withColumn("rate", F.col("c") / F.col("total")).withColumn("most", F.max("rate").over(Window.partitionBy("g")))
    chosen = rated.where("c > 1 and rate >= 0.25 * most").select("lang", "g").toArrow()  # the model's own n-grams
    discard(spark, counted)
    names, grams = chosen.column("lang").to_pandas(), chosen.column("g").to_numpy()
    found = {k: np.sort(grams[at]).astype(np.uint32) for k, at in names.groupby(names).indices.items()}
    return Model.build(found, bits)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs.

    lang_pred is `und` (score 0) where the text is null or has no letter; ties go to the first language by
    name. Rows with a null doc_id keep it, with held_out null.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            found = [shared.value.predict(t) for t in as_bytes(batch.column("text"))]
            held = [None if i is None else zlib.crc32(str(i).encode()) % 3 == 1 for i in ids]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def least_scores(docs: DataFrame, model: Model, below: float = 0.001, slack: float = 0.9) -> dict[str, float]:
    """For each language the least score that its texts should have.

    It is `slack` times what all but the share `below` of held-out documents (crc32(doc_id) mod 3 of 1) of the language
    have, of all that are recognised. No margin over the second language is asked: a text that mixes learned languages
    is not in an unlearned one.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").where("doc_id is not null and lang is not null and crc32(cast(cast(doc_id as string) as binary)) % 3 = 1")

    def run(batches):
        for batch in batches:
            found = [(n, *shared.value.ranked(t)) for n, t in zip(batch.column("lang").to_pylist(), as_bytes(batch.column("text")), strict=True)]
            found = [(n, score) for n, lang, score, _ in found if lang == n]
            bits = np.array([f[1] for f in found], np.float64).view(np.int64)  # in the order of the scores, as none is negative
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array(bits)], ["lang", "bits"])

    scored = stored(rows.mapInArrow(run, "lang string, bits long"), "scores")
    found = _quantiles(scored, below)
    discard(spark, scored)
    return {lang: slack * float(np.int64(b).view(np.float64)) for lang, b in found.items()}


def _quantiles(scored: DataFrame, below: float) -> dict[str, int]:
    """For each lang of scored (lang, bits of a double from 0 to 1) the exact value of rank ceil(below * rows), 1 at least.

    Each look counts rows by the next `STEP` bits, so no task and no result holds more than 2 ** STEP counts of a
    language, however many rows it has. There are seven looks at most, at a table of two narrow columns."""
    found, part, shift = {}, scored, SCORE_BITS
    ranks: dict[str, int] = {}
    while True:
        shift = max(0, shift - STEP)
        bins: dict[str, list] = {}
        for r in part.groupBy("lang", F.shiftright("bits", shift).alias("first")).agg(F.count(F.lit(1)).alias("n"), F.min("bits").alias("least"), F.max("bits").alias("most")).collect():
            bins.setdefault(r["lang"], []).append((r["first"], r["n"], r["least"], r["most"]))
        unsettled = []
        for lang, counts in bins.items():
            rank = ranks.get(lang) or max(1, math.ceil(Fraction(str(below)) * sum(c[1] for c in counts)))
            for first, n, least, most in sorted(counts):
                if rank <= n:
                    break
                rank -= n
            ranks[lang] = rank
            if rank in (1, n) or least == most:
                found[lang] = least if rank == 1 else most
            else:
                unsettled.append((lang, first))
        if not unsettled:
            return found
        wanted = scored.sparkSession.createDataFrame(unsettled, "lang string, first long")
        part = scored.join(F.broadcast(wanted), "lang").where(F.shiftright("bits", shift) == F.col("first")).select("lang", "bits")


def keep_known(docs: DataFrame, model: Model, least: float = 0.1, own: dict[str, float] | None = None) -> DataFrame:
    """docs whose text is in one of the model's languages with a score of `least`, and with the score that
    `own` (see least_scores) asks of its language, less what chance does to a text of n n-grams (two standard
    deviations of a share, 1 / sqrt(n) at most); all columns come through."""
    shared, asked = docs.sparkSession.sparkContext.broadcast(model), own or {}

    def known(lang, score, n):
        return lang != "und" and score >= max(least, asked.get(lang, 0.0) - max(1, n) ** -0.5)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([known(*shared.value.ranked(t)) for t in as_bytes(batch.column("text"))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
