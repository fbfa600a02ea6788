"""Shared parts of the corpus operators: the shared work folder, vectorised word hashing and
side tables that bring decisions back to a text without moving the text.

Texts are by far the widest column of a corpus, so no operator here shuffles them where a scan will do.
A first scan sends hashes, a shuffle decides on the hashes, and a side table keyed by the scan's own
partition number carries each decision back to the same partition of a second scan.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on; a longer text is a step of its own.
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent, a session of this machine alone (master local, as in tests) gets a folder of it; on a
    cluster that is an error, since each executor would write to a disk of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="tesserae-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def bounded_batches(spark: SparkSession) -> None:
    """Has Arrow batches of texts stay small, 1000 rows and 16 MB, unless the session asks for less.

    A setting of the session, since batches are made when a query runs; results don't depend on it."""
    for name, most in (("maxRecordsPerBatch", 1000), ("maxBytesPerBatch", 16 << 20)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}", None)
        size = int(now.removesuffix("b")) if now and now.removesuffix("b").lstrip("-").isdigit() else -1
        if not 0 < size <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder: its lineage is cut and it outlives lost executors."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def discard(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Deletes tables of stored() or write_side() that nothing will read again."""
    for t in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(t if isinstance(t, str) else t.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and inner path of a shared folder, for tasks that read or write plain files."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


# ---------------------------------------------------------------- hashing


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shifts and multiplications of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse; those of a usual step are kept."""

    def __init__(self, base: int):
        self.base, self.kept = base, None

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if self.kept is not None and n <= len(self.kept[0]):
            return self.kept[0][:n], self.kept[1][:n]
        size = max(n, CHUNK_BYTES + 4096)
        powers = []
        for base in (self.base, pow(self.base, -1, 1 << 64)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            powers.append(np.multiply.accumulate(x))
        if size == CHUNK_BYTES + 4096:
            self.kept = tuple(powers)
        return powers[0][:n], powers[1][:n]


_POWERS = {0: _Powers(0x9E3779B97F4A7C15), 1: _Powers(0xD6E8FEB86659FD93)}


class Words:
    """Words of a list of byte texts (None: no words): starts and ends in one joined buffer, owner texts, hashes.

    A word's hash is a polynomial over its bytes, read off prefix sums, then mixed with its length.
    """

    def __init__(self, texts: list[bytes | None], lower: bool = False):
        joined = b" ".join(t or b"" for t in texts)
        if lower:
            joined = joined.lower()  # of bytes: A-Z only
        self.joined = joined
        self.buffer = np.frombuffer(joined, np.uint8)
        lengths = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
        self.offsets = np.concatenate([[0], np.cumsum(lengths + 1)])
        inside = np.zeros(len(joined) + 2, np.int8)
        inside[1:-1] = ~_SPACE[self.buffer]
        edge = np.diff(inside)
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        #: first[i]: number of the first word of text i
        self.first = np.searchsorted(self.starts, self.offsets)
        self.owner = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def hashes(self, seed: int = 0) -> np.ndarray:
        """In blocks of words of about CHUNK_BYTES, so that a very long text needs little more than itself."""
        out, i = np.empty(len(self.starts), np.uint64), 0
        while i < len(out):
            base = self.starts[i]
            j = max(i + 1, int(np.searchsorted(self.ends, base + CHUNK_BYTES, "right")))
            starts, ends = self.starts[i:j] - base, self.ends[i:j] - base
            n = int(ends[-1])
            up, down = _POWERS[seed].get(n + 1)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum((self.buffer[base : base + n].astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
            raw = (sums[ends] - sums[starts]) * down[starts]
            out[i:j] = mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
            i = j
        return out


def grams(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of k consecutive word hashes, whichever texts they belong to."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, factor = np.zeros(n, np.uint64), (0x9FB21C651E98DF25, 0xC3A5C85C97CB3127)[seed]
    for j in range(k):
        out += words[j : j + n] * np.uint64(pow(factor, j + 1, 1 << 64))
    return mix(out + np.uint64(k))


def chunks(texts: list[bytes | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about limit bytes each, one text at least."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t) + 1 if t else 1
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


# ---------------------------------------------------------------- numbered scans and side tables


def _xxhash64(*columns: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of columns of longs."""
    one, two, three, four, five = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turned(x, n):
        return x << np.uint64(n) | x >> np.uint64(64 - n)

    h = np.full(len(columns[0]), 42, np.uint64)
    for c in columns:
        h = turned(h + five + np.uint64(8) ^ turned(c.astype(np.int64).view(np.uint64) * two, 31) * one, 27) * one + four
        h = (h ^ h >> np.uint64(33)) * two
        h = (h ^ h >> np.uint64(29)) * three
        h ^= h >> np.uint64(32)
    return h


class Numbered:
    """A table whose scan partitions are numbered, so that a later scan finds what was said of its rows.

    Spark plans a scan of the same files the same way within a session. That is not left to trust: the number of rows
    of each partition and the exclusive or of hashes of (position, id) are taken first and compared by each later scan,
    which fails rather than go on with another partitioning or order. An input that is not a plain scan of files is
    written to the shared folder first.
    """

    def __init__(self, df: DataFrame, key: str):
        spark = df.sparkSession
        bounded_batches(spark)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        if any(x in plan for x in ("Join", "Aggregate", "Repartition", "Sort", "Window", "MapIn", "LogicalRDD", "LocalRelation", "Limit", "Sample", "Union", "Range", "Generate")):
            df = stored(df, "numbered")
        self.df, self.key, self.spark = df, key, spark
        pos = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        found = (
            df.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(0).cast("long")).alias("k"), pos.alias("pos"), F.spark_partition_id().alias("pid"))
            .groupBy("pid").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("pos", "k")).alias("x")).collect()
        )  # one row for each partition
        self.seals = spark.sparkContext.broadcast({r["pid"]: (r["n"], r["x"] & (1 << 64) - 1) for r in found})
        self.partitions = max(1, len(found))

    def scan(self, step: Callable, schema: str, columns: list[str] | None = None, side: str | None = None) -> DataFrame:
        """step(pid, batches, side) over each partition; side(columns) reads this partition's side rows as an Arrow table.

        A batch has the key as `k` (long), columns by name, or the whole row as struct `row` if columns is None.
        """
        seals = self.seals
        picked = [F.struct("*").alias("row")] if columns is None else [F.col(f"`{c}`") for c in columns]
        source = self.df.select(F.spark_partition_id().alias("pid"), F.col(f"`{self.key}`").cast("long").alias("k"), *picked)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = {"n": 0, "x": 0, "pid": None}

            def watched(first: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
                batch = first
                while batch is not None:
                    if batch.num_rows:
                        pos = np.arange(seen["n"], seen["n"] + batch.num_rows)
                        seen["n"] += batch.num_rows
                        seen["x"] ^= int(np.bitwise_xor.reduce(_xxhash64(pos, batch.column("k").fill_null(0).to_numpy(zero_copy_only=False))))
                        yield batch
                    batch = next(batches, None)

            first = next((b for b in batches if b.num_rows), None)
            if first is None:
                return
            pid = first.column("pid")[0].as_py()
            yield from step(pid, watched(first), (lambda *names: read_side(side, pid, list(names))) if side else None)
            if seals.value.get(pid) != (seen["n"], seen["x"]):
                raise RuntimeError(f"partition {pid} of the scan holds other rows than in the first scan")

        return source.mapInArrow(run, schema)


#: Scan partitions whose side rows lie in one folder, in files sorted by partition.
SIDE_PARTITIONS = 16


def write_side(rows: DataFrame, name: str, scan: Numbered) -> str:
    """Writes rows, which have a column pid, as a side table of the scan; returns its path.

    There is a task for each partition of the scan and a folder for each `SIDE_PARTITIONS` of them."""
    path = work_dir(rows.sparkSession, name)
    part = F.floor(F.col("pid") / SIDE_PARTITIONS).cast("int")
    dealt = rows.withColumn("part", part).repartitionById(scan.partitions, F.col("pid")).sortWithinPartitions("part", "pid")
    dealt.write.option("parquet.block.size", 1 << 20).partitionBy("part").parquet(path)
    return path


def read_side(path: str, pid: int, columns: list[str]) -> pa.Table | None:
    """The rows of one partition in a side table, or None."""
    fs, inner = file_system(path)
    inner = f"{inner}/part={pid // SIDE_PARTITIONS}"
    if fs.get_file_info(inner).type == pafs.FileType.NotFound:
        return None
    table = pads.dataset(inner, filesystem=fs, format="parquet").to_table(columns=columns, filter=pads.field("pid") == pid)
    return table if table.num_rows else None
