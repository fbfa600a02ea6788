"""Exact top-k search with vector-approximation files.

1. Vectors are packed into blocks and written once. A block holds its vectors as they came and, as the approximation
   file, one byte for each component: its cell on a grid of the block's own range. A column of its own, so the
   approximation is scanned alone.
2. The scan of cells bounds every inner product of a query and a vector of a block from both sides (the half width of
   a cell is the same for all vectors of a block, so a bound costs one product of single-precision matrices). What can't
   be among the k best of its block ends here; the k-th lower bound of a query over all blocks ends most of the rest.
3. Exact vectors are read for what is left, for each query in the order of bounds until the k-th score is certain.

Queries are blocks as well, dealt to groups of candidate blocks; a block of queries is sent once to each group.
Blocks are named by partition and number and read back from the written table, so a task that is run again after a
lost executor finds the same ones.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import discard, stored

#: Vectors and bytes of cells of a block of candidates at most, and queries of a block of queries.
CANDIDATES, CELL_BYTES, QUERIES = 32_768, 4 << 20, 512
LEVELS = 256
#: Vectors with an integer component beyond this have no cells: nothing bounds their scores, so all are read.
WIDE = 2.0**40
LONG = (-(1 << 63), (1 << 63) - 1)

_BLOCK = "block long, d int, wide boolean, ids binary, low binary, width binary, cells binary, exact binary"


def valid(column: str) -> str:
    """SQL for a vector without null, NaN and infinite components."""
    return f"{column} is not null and not exists({column}, x -> x is null or isnan(x) or abs(x) = double('infinity'))"


def scaled(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) in double precision; infinite where that has no such number."""
    with np.errstate(over="ignore"):
        return np.floor(scale * x)


def exact_score(a: np.ndarray, b: np.ndarray, scale: int) -> int:
    """The integer inner product of floor(scale * a) and floor(scale * b), of any size."""
    x, y = scaled(a, scale), scaled(b, scale)
    if len(x) * float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) < 2.0**53:
        return int(x @ y)  # all sums are exact
    whole = lambda z, raw: [int(i) if np.isfinite(i) else scale * int(r) for i, r in zip(z.tolist(), raw.tolist(), strict=True)]
    return sum(i * j for i, j in zip(whole(x, a), whole(y, b), strict=True))


def _cells(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lowest value and cell width of each component, and each vector's cells."""
    low = x.min(0)
    width = np.maximum(x.max(0) - low, 1) / (LEVELS - 1)
    return low, width, np.rint((x - low) / width).astype(np.uint8)


def bounds(queries: np.ndarray, low: np.ndarray, width: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Approximate scores of queries and cells, and how far each query's scores may be off."""
    near = (queries * width).astype(np.float32) @ cells.T.astype(np.float32) + (queries @ low)[:, None]
    part = np.abs(queries) @ width
    rounding = (len(width) + 4) * 2.0**-23 * LEVELS * part + 1e-12 * (np.abs(queries) @ np.abs(low)) + 2.0**-22 * np.abs(queries @ low) + 1e-6
    return near, part / 2 + rounding


def _blocks(rows: DataFrame, size: int, scale: int, cells: bool) -> DataFrame:
    """Blocks of vectors of one length each, wide ones by themselves."""

    def run(batches):
        held: dict[tuple[int, bool], tuple[list, list]] = {}
        number = TaskContext.get().partitionId() << 32

        def pack(d, wide, ids, vectors):
            nonlocal number
            number += 1
            x = np.array(vectors, np.float64).reshape(len(ids), d)
            low, width, codes = _cells(scaled(x, scale)) if cells and not wide else (np.zeros(0),) * 3
            data = [np.array(ids, np.int64), low, width, codes, x]
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([d], pa.int32()), pa.array([wide]), *(pa.array([y.tobytes()], pa.binary()) for y in data)], [f.split()[0] for f in _BLOCK.split(", ")])

        for batch in batches:
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("v").to_pylist(), strict=True):
                x = np.array(v, np.float64)
                key = len(v), bool(np.abs(x).max(initial=0) * scale >= WIDE)
                ids, vectors = held.setdefault(key, ([], []))
                ids.append(i)
                vectors.append(x)
                if len(ids) == max(1, min(size, CELL_BYTES // max(1, len(v)))):
                    yield pack(*key, *held.pop(key))
        for key, (ids, vectors) in held.items():
            yield pack(*key, ids, vectors)

    return rows.mapInArrow(run, _BLOCK)


def _scan(pairs: DataFrame, k: int, scale: int) -> DataFrame:
    """query, block, at, low, high: what may be among the k best of its block, by the bounds of its score."""

    def one(d, wide, ids, low, width, cells, q_wide, q_ids, q_exact):
        ids, q_ids = np.frombuffer(ids, np.int64), np.frombuffer(q_ids, np.int64)
        own = q_ids[:, None] == ids[None, :]
        if wide or q_wide or not d:
            high = np.full(own.shape, np.inf if d else 0.0)
            slack = np.full(len(q_ids), np.inf if d else 0.0)
            lower = -high
        else:
            queries = scaled(np.frombuffer(q_exact).reshape(-1, d), scale)
            near, slack = bounds(queries, np.frombuffer(low), np.frombuffer(width), np.frombuffer(cells, np.uint8).reshape(-1, d))
            high, lower = near + slack[:, None], near - slack[:, None]
        high[own] = lower[own] = -np.inf
        kth = np.partition(lower, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(q_ids), -np.inf)
        q, at = np.nonzero((high >= kth[:, None]) & ~own)
        return q, at, lower[q, at], high[q, at]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                block, query = row.pop("block"), row.pop("query")
                q, at, low, high = one(**row)
                yield pa.RecordBatch.from_arrays([pa.array(query + q), pa.array(np.full(len(q), block)), pa.array(at.astype(np.int32)), pa.array(low), pa.array(high)], ["query", "block", "at", "low", "high"])

    return pairs.mapInArrow(run, "query long, block long, at int, low double, high double")


def top_k(vectors: DataFrame, is_query: str = "vec_id % 20 = 0", k: int = 20, scale: int = 64, groups: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k greatest integer inner products of each query, ties to smaller ids.

    Takes vec_id and embedding. Vectors that are null or hold a null or non-finite component take no part, nor do
    rows with a null vec_id; vectors of different lengths aren't compared, empty ones score 0 with each other. A query
    isn't compared with rows of its own vec_id; a repeated row is a candidate of its own, a repeated query asks once; an
    id with several vectors asks with each of them and has the k best of all. A score beyond 64 bits is ranked as it is
    and returned as the nearest long. An empty table has an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(f"vec_id is not null and {valid('v')}")
    candidates = stored(_blocks(rows, CANDIDATES, scale, True), "cells")
    queries = stored(_blocks(rows.where(is_query).dropDuplicates(["vec_id", "v"]), QUERIES, scale, False).drop("low", "width", "cells"), "queries")
    groups = groups or max(1, min(4096, candidates.count()))
    asked = queries.withColumn("g", F.explode(F.expr(f"sequence(0L, {groups - 1}L)"))).select("g", "d", (F.col("block") * QUERIES).alias("query"), F.col("wide").alias("q_wide"), F.col("ids").alias("q_ids"), F.col("exact").alias("q_exact"))
    pairs = candidates.select(F.pmod(F.xxhash64("block"), F.lit(groups)).alias("g"), "d", "block", "wide", "ids", "low", "width", "cells").join(asked, ["g", "d"]).drop("g")
    found = stored(_scan(pairs, k, scale), "bounds")

    best = Window.partitionBy("query").orderBy(F.desc("low"))
    kth = found.select("query", "low").withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).groupBy("query").agg(F.min("low").alias("kth"), F.count(F.lit(1)).alias("n"))
    least = kth.select("query", F.when(F.col("n") == k, F.col("kth")).otherwise(F.lit(float("-inf"))).alias("kth"))
    left = found.join(least, "query").where("high >= kth").select("query", "block", "at", "high")
    left = stored(left, "left")

    def read(batches):
        """block, at, vec_id, v of the vectors wanted of each block."""
        for batch in batches:
            for block, d, ids, exact, wanted in zip(*(batch.column(c).to_pylist() for c in ("block", "d", "ids", "exact", "wanted")), strict=True):
                ids, x, wanted = np.frombuffer(ids, np.int64), np.frombuffer(exact), np.array(wanted, np.int32)
                x = x.reshape(len(ids), d)
                for i in range(0, len(wanted), 1000):
                    part = wanted[i : i + 1000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block)), pa.array(part), pa.array(ids[part]), pa.array([x[j].tobytes() for j in part], pa.binary())], ["block", "at", "vec_id", "v"])

    wanted = left.groupBy("block").agg(F.collect_set("at").alias("wanted"))  # of one block
    exact = candidates.select("block", "d", "ids", "exact").join(wanted, "block").mapInArrow(read, "block long, at int, vec_id long, v binary")

    def split(batches):
        for batch in batches:
            for block, d, ids, exact in zip(*(batch.column(c).to_pylist() for c in ("block", "d", "ids", "exact")), strict=True):
                ids = np.frombuffer(ids, np.int64)
                x = np.frombuffer(exact).reshape(len(ids), d)
                yield pa.RecordBatch.from_arrays([pa.array(block * QUERIES + np.arange(len(ids))), pa.array(ids), pa.array([y.tobytes() for y in x], pa.binary())], ["query", "query_id", "q"])

    own = queries.mapInArrow(split, "query long, query_id long, q binary")
    read_in_order = left.join(exact, ["block", "at"]).join(own, "query").repartition("query_id").sortWithinPartitions("query_id", F.desc("high")).select("query_id", "high", "vec_id", "q", "v")

    def rank(batches):
        now, heap = None, []  # of (score, -vec_id), the least first

        def close():
            best = sorted(heap, reverse=True)
            score = [min(max(s, LONG[0]), LONG[1]) for s, _ in best]
            return pa.RecordBatch.from_arrays([pa.array([now] * len(best), pa.int64()), pa.array(np.arange(1, len(best) + 1, dtype=np.int32)), pa.array([-v for _, v in best], pa.int64()), pa.array(score, pa.int64())], ["query_id", "rank", "vec_id", "score"])

        for batch in batches:
            for i, high, vec, q, v in zip(*(batch.column(c).to_pylist() for c in ("query_id", "high", "vec_id", "q", "v")), strict=True):
                if i != now:
                    if heap:
                        yield close()
                    now, heap = i, []
                if len(heap) == k and high < heap[0][0]:
                    continue  # certain: bounds only fall from here
                item = exact_score(np.frombuffer(q), np.frombuffer(v), scale), -vec
                (heapq.heappush if len(heap) < k else heapq.heappushpop)(heap, item)
        if heap:
            yield close()

    result = stored(read_in_order.mapInArrow(rank, "query_id long, rank int, vec_id long, score long"), "nearest")
    discard(spark, candidates, queries, found, left)
    return result
