"""MinHash near-dedup with bottom-k sketches from one hash function.

1. A scan takes each document's set of word shingles, its size, a 128-bit digest and the `SKETCH` smallest
   hashes. Equal sets collapse to their smallest document.
2. Inverted lists of the `LISTED` smallest values give candidates: lists of up to `SHORT` sets all their pairs, those
   with one chosen member first. Sets that are crowded, with too few values outside longer lists, are listed once more
   among themselves by their whole sketches, which tells sets that share a common passage from near copies.
3. What is still crowded then belongs to large groups of near copies. Each long list has a pivot, its most popular
   member, and a member is compared with the pivots of most of its lists, one or two as a rule. Members x, y that
   aren't both linked with pivot h are found by what they share of their deviations from it: with Z the symmetric
   difference of a set and h, x and y are linked only if |Zx ^ Zy| <= c (|x| + |y|), c = (1 - s) / (1 + s), while
   |Zx| > c (|x| + |h|) if x isn't linked with h. That is a join by overlap: prefixes of Z, rarest elements first, hold
   a common element for certain, and its ranks in both bound the overlap. Members linked with h are one component
   already and send only the elements that some unlinked member has.
4. Sketches of a candidate pair, also of a pair with a pivot, give the sketch of the union and so an estimate; pairs
   clearly below the threshold aren't linked. The rest is confirmed by integer arithmetic on full sets, which a second
   scan sends for the documents concerned.
5. Components of confirmed links; later candidates within one component are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import Numbered, Words, as_bytes, chunks, discard, grams, mix, stored, write_side
from tesserae.llm.components import components

SKETCH, LISTED, SHORT = 64, 16, 24
#: An estimate so far under the threshold ends a pair: over five standard errors of a sketch of 64.
SLACK = 0.3
#: A set is crowded if fewer than `enough` of its first `first` values lie outside long lists. Of a set linked at 0.8 at
#: most a fifth isn't in the other set, so the other set has none of them with a chance of P(Bin(first, 0.2) >= enough)
#: at most: 3e-7 for 13 of 16, 1e-8 for 28 of 48 (whole sketches are listed, so these 48 are in the other's list).
ENOUGH, DEEP_ENOUGH, DEEP_FIRST = 13, 28, 48

_SKETCHED = "pid int, pos long, doc_id long, n long, a long, b long, sketch binary"


def shingle_sets(texts: list[bytes | None], k: int) -> list[np.ndarray]:
    """Sorted hashes of the distinct k-word shingles of each text; of a shorter text, its whole word sequence."""
    words = Words(texts, lower=True)
    hashes = words.hashes()
    runs = grams(hashes, k)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(runs[a : b - k + 1]))
        else:
            out.append(grams(hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def _signed(x) -> int:
    x = int(x)
    return x - (1 << 64) if x >> 63 else x


def sketches(scan: Numbered, k: int) -> DataFrame:
    def step(pid, batches, _):
        pos = 0
        for batch in batches:
            ids, texts, rows = batch.column("k").to_pylist(), as_bytes(batch.column("text")), []
            for a, b in chunks(texts):
                for i, s in zip(ids[a:b], shingle_sets(texts[a:b], k), strict=True):
                    one, two = mix(s ^ np.uint64(0x5851F42D4C957F2D)), mix(s + np.uint64(0x14057B7EF767814F))
                    rows.append((pid, pos, i, len(s), _signed(np.add.reduce(one, dtype=np.uint64)), _signed(np.bitwise_xor.reduce(two) if len(s) else 0), s[:SKETCH].tobytes()))
                    pos += 1
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int32(), *[pa.int64()] * 5, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["pid", "pos", "doc_id", "n", "a", "b", "sketch"])

    return scan.scan(step, _SKETCHED, ["text"])


def _lists(sets: DataFrame, listed: int = LISTED) -> DataFrame:
    """v, doc, n, at: a row for each of the first `listed` values of each sketch, at counts them from 0."""

    def run(batches):
        for batch in batches:
            docs, ns, data = batch.column("doc").to_numpy(), batch.column("n").to_numpy(), batch.column("sketch").to_pylist()
            values = [np.frombuffer(x, np.uint64)[:listed] for x in data]
            sizes = [len(v) for v in values]
            if sum(sizes):
                at = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(values).view(np.int64)), pa.array(np.repeat(docs, sizes)), pa.array(np.repeat(ns, sizes)), pa.array(at)], ["v", "doc", "n", "at"])

    return sets.select("doc", "n", "sketch").mapInArrow(run, "v long, doc long, n long, at int")


def _chosen(lists: DataFrame) -> DataFrame:
    """v, size, head of all lists with two members at least; head is the member with the smallest hash."""
    head = F.min(F.struct(F.xxhash64("v", "doc").alias("h"), F.col("doc").alias("doc"), F.col("n").alias("n")))
    return lists.groupBy("v").agg(F.count(F.lit(1)).alias("size"), head.alias("head")).where("size > 1").select("v", "size", F.col("head.doc").alias("head"), F.col("head.n").alias("head_n"))


def _similar_sizes(a: str, b: str, percent: int) -> str:
    return f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})"


def _crowded(listed: DataFrame, first: int, enough: int) -> DataFrame:
    """doc: those with too few of their first values outside long lists."""
    hot = listed.where((F.col("size") > SHORT) & (F.col("at") < first)).groupBy("doc", "n").agg(F.count(F.lit(1)).alias("hot"))
    return hot.where(f"least(n, {first}) - hot < least({enough}, 0.25 * n + 1)").select("doc")


def _covering(pivoted: DataFrame) -> DataFrame:
    """doc, head: the pivots of all but a few of each member's long lists, those of most lists first.

    A member leaves out pivots of a fifth of its first values at most. Linked sets that both leave out so many still
    share a pivot unless they differ in three fifths of their first values (see DEEP_ENOUGH)."""
    counted = pivoted.groupBy("doc", "n", "head").agg(F.count(F.lit(1)).alias("lists"))
    fewest_first = Window.partitionBy("doc").orderBy("lists", F.xxhash64("head"), "head")
    left_out = F.sum("lists").over(fewest_first)
    return counted.withColumn("left_out", left_out).where(f"left_out > floor(0.2 * least(n, {DEEP_FIRST})) and doc <> head").select("doc", "head")


def _estimated(candidates: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """x, y, pivot, likely of candidate pairs: whether the union sketch doesn't rule them out. Only pairs with pivots
    come through if it does."""
    one = sets.select(F.col("doc").alias("x"), F.col("sketch").alias("sx"))
    two = sets.select(F.col("doc").alias("y"), F.col("sketch").alias("sy"))
    pairs = candidates.join(two, "y").join(one, "x").select("x", "y", "pivot", "sx", "sy")

    def run(batches):
        for batch in batches:
            likely = []
            for sx, sy in zip(batch.column("sx").to_pylist(), batch.column("sy").to_pylist(), strict=True):
                a, b = np.frombuffer(sx, np.uint64), np.frombuffer(sy, np.uint64)
                union = np.unique(np.concatenate([a, b]))[:SKETCH]
                # a sketch shorter than SKETCH is the whole set, so a missing value is truly absent
                common = np.intersect1d(np.intersect1d(a, b, assume_unique=True), union, assume_unique=True)
                likely.append(len(common) >= (percent / 100 - SLACK) * len(union))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("x", "y", "pivot")), pa.array(likely, pa.bool_())], ["x", "y", "pivot", "likely"])

    return pairs.mapInArrow(run, "x long, y long, pivot boolean, likely boolean").where("pivot or likely")


def _prefixes(nz: int, nx: int, nh: int, linked: bool, percent: int) -> tuple[int, int]:
    """How many of the rarest of nz deviations of a set of nx elements from a pivot of nh must be listed to meet an
    unlinked set (for an unlinked x: to meet another unlinked one) and, for an unlinked x, to meet a linked one."""
    t = percent / 100
    c = (1 - t) / (1 + t)
    half = nz - int(max(0.0, (nz - c * (nx - nh)) / 2 - 1e-9))
    wide = int(c * nx * (1 + 1 / t) + 1e-9) + 1
    return (half, 0) if linked else (min(half, wide), wide)


_COMPARED = "x long, y long, linked boolean, n long, m long, half long, wide long, z array<long>"


def _compared(scan: Numbered, pairs: DataFrame, sketched: DataFrame, k: int, percent: int) -> DataFrame:
    """A row for each pair x, y that is linked (100 * intersection >= percent * union of full sets) or whose y is a
    pivot: then with x's size n, its m deviations z from y and the prefixes to list (see _prefixes)."""
    pairs = stored(pairs, "pairs")
    wanted = pairs.select(F.col("x").alias("doc_id")).unionByName(pairs.select(F.col("y").alias("doc_id"))).distinct()
    side = write_side(sketched.where("n > 0").select("pid", "doc_id", "pos").join(wanted, "doc_id", "left_semi"), "wanted", scan)

    def step(pid, batches, side):
        table = side("doc_id", "pos")
        rows = dict(zip(table.column("pos").to_pylist(), table.column("doc_id").to_pylist(), strict=True)) if table else {}
        pos = 0
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            mine = [(rows[pos + i], texts[i]) for i in range(len(texts)) if pos + i in rows]
            pos += len(texts)
            own = [t for _, t in mine]
            for a, b in chunks(own):
                sets = shingle_sets(own[a:b], k)
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in mine[a:b]], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc", "members"])

    full = stored(scan.scan(step, "doc long, members binary", ["text"], side), "sets")
    both = pairs.join(full.select(F.col("doc").alias("y"), F.col("members").alias("my")), "y").join(full.select(F.col("doc").alias("x"), F.col("members").alias("mx")), "x")

    def run(batches):
        for batch in batches:
            out = []
            for x, y, pivot, likely, mx, my in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "pivot", "likely", "mx", "my")), strict=True):
                a, b = np.frombuffer(mx, np.uint64), np.frombuffer(my, np.uint64)
                linked = False
                if likely:
                    common = len(np.intersect1d(a, b, assume_unique=True))
                    linked = 100 * common >= percent * (len(a) + len(b) - common)
                if pivot:
                    z = np.setxor1d(a, b, assume_unique=True)
                    out.append((x, y, linked, len(a), len(z), *_prefixes(len(z), len(a), len(b), linked, percent), z.view(np.int64)))
                elif linked:
                    out.append((x, y, True, len(a), 0, 0, 0, None))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * 4, pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [f.split()[0] for f in _COMPARED.split(", ")])

    compared = stored(both.select("x", "y", "pivot", "likely", "mx", "my").mapInArrow(run, _COMPARED), "compared")
    discard(scan.spark, pairs, full, side)
    return compared


def _deviations(compared: DataFrame) -> tuple[DataFrame, DataFrame, tuple[DataFrame, DataFrame]]:
    """Rows h, z, doc, n, m, half, rank of unlinked members and of members linked with h: the elements that others may
    meet them by. rank is that of z among all of a member's deviations, in one order for all members of h: elements
    that no unlinked member has first (they meet nothing and have no row), then the rarest. Also the stored tables that
    these rows are read from."""
    own = compared.where("z is not null").withColumnsRenamed({"x": "doc", "y": "h"})
    apart = stored(own.where("not linked").withColumn("z", F.explode("z")), "apart")
    held = apart.groupBy("h", "z").agg(F.count(F.lit(1)).alias("r"))
    near = stored(own.where("linked").withColumn("z", F.explode("z")).join(held, ["h", "z"], "left_semi"), "near")
    sizes = apart.select("h", "z").unionByName(near.select("h", "z")).groupBy("h", "z").agg(F.count(F.lit(1)).alias("size"))
    member = Window.partitionBy("h", "doc")
    ranked = [x.join(sizes, ["h", "z"]).withColumn("rank", F.row_number().over(member.orderBy("size", "z"))) for x in (apart, near)]
    near_rank = F.col("rank") + F.col("m") - F.count(F.lit(1)).over(member)
    columns = ["h", "z", "doc", "n", "m", "half", "rank"]
    return ranked[0].where("size > 1 and rank <= greatest(half, wide)").select(columns), ranked[1].withColumn("rank", near_rank).where("rank <= half").select(columns), (apart, near)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, by_row: bool = False) -> tuple[Numbered, DataFrame]:
    """The numbered scan of docs and, for each of its rows: pid, pos, doc_id, n, component.

    Texts without words have no set and are linked with nothing; rows with a null doc_id are left out; rows
    that share a doc_id are one node. Sets differ only from six shingles on if they are to be 85 % alike
    (five at 80 %), which needs no rule of its own here: equal sets collapse, others must share values.

    With by_row each row is a node of its own, whatever its doc_id: doc_id and component are then numbers made of pid
    and pos, and the rows have the doc_id they came with as key.
    """
    scan = Numbered(docs, "doc_id")
    sketched = sketches(scan, k)
    if by_row:
        node = F.shiftleft(F.col("pid").cast("long"), 40) + F.col("pos")
        sketched = sketched.withColumn("key", F.col("doc_id")).withColumn("doc_id", node)
    sketched = stored(sketched.where("doc_id is not null"), "sketches")
    sets = stored(sketched.where("n > 0").groupBy("n", "a", "b").agg(F.min("doc_id").alias("doc"), F.first("sketch").alias("sketch")), "sets")

    lists = _lists(sets)
    listed = stored(lists.join(_chosen(lists), "v"), "listed")  # no value that only one set has
    few = stored(sets.join(_crowded(listed, LISTED, ENOUGH), "doc", "left_semi").select("doc", "n", "sketch"), "few")
    deep = _lists(few, SKETCH)
    deep = stored(deep.join(_chosen(deep), "v"), "deep")
    # the member whose whole sketch is most common stands nearest to the text that the others are copies of
    popular = deep.groupBy("doc").agg(F.sum("size").alias("popular"))
    dense = popular.join(_crowded(deep, DEEP_FIRST, DEEP_ENOUGH), "doc", "left_semi")
    long_lists = deep.where((F.col("size") > SHORT) & (F.col("at") < DEEP_FIRST)).select("v", "doc", "n").join(dense, "doc")
    pivots = long_lists.groupBy("v").agg(F.count(F.lit(1)).alias("size"), F.max(F.struct("popular", F.xxhash64("doc").alias("h"), "doc", "n")).alias("p")).where("size > 1").select("v", "size", F.col("p.doc").alias("head"), F.col("p.n").alias("head_n"))
    pivoted = stored(long_lists.join(pivots, "v").select("v", "size", "doc", "n", "head", "head_n"), "pivoted")
    short = listed.unionByName(deep).drop("at").unionByName(pivoted).where(F.col("size") <= SHORT).select("v", "doc", "n", "head", "head_n")
    to_pivot = _covering(pivoted.where(F.col("size") > SHORT)).select(F.col("doc").alias("x"), F.col("head").alias("y"))

    starred = short.where(_similar_sizes("n", "head_n", percent)).select(F.least("doc", "head").alias("x"), F.greatest("doc", "head").alias("y")).where("x < y").distinct()
    first = _estimated(starred.withColumn("pivot", F.lit(False)).unionByName(to_pivot.withColumn("pivot", F.lit(True))), sets, percent)
    compared = _compared(scan, first, sketched, k, percent)
    links = compared.where("linked").select("x", "y")
    known = stored(components(links), "components")

    def placed(rows):
        return rows.join(known.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))

    def met(left, right, on, more="true"):
        """Pairs of rows that meet, in different components so far and of similar sizes."""
        a, b = (x.select(*on, *(F.col(c).alias(c + d) for c in x.columns if c not in on)).withColumnRenamed(f"doc{d}", d) for x, d in ((left, "x"), (right, "y")))
        met_ = f"componentx <> componenty and {_similar_sizes('nx', 'ny', percent)} and {more}"
        return a.join(b, on).where(met_).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))

    mixed = placed(short)
    many = mixed.groupBy("v").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("v")
    rest = stored(mixed.join(many, "v", "left_semi").select("v", "doc", "n", "component"), "rest")
    apart, near, raw = _deviations(compared)
    apart, near = stored(placed(apart), "deviations"), placed(near)
    # the first common element leaves 1 + least(mx - rankx, my - ranky) common ones at most; links need so many:
    enough = f"2 * (1 + least(mx - rankx, my - ranky)) * {100 + percent} >= (mx + my) * {100 + percent} - {100 - percent} * (nx + ny)"
    prefix = apart.where("rank <= half")
    second = met(rest, rest, ["v"]).unionByName(met(prefix, prefix, ["h", "z"], enough)).unionByName(met(apart, near, ["h", "z"], enough)).distinct()
    more = _compared(scan, _estimated(second.withColumn("pivot", F.lit(False)), sets, percent), sketched, k, percent)
    found = components(links.unionByName(more.select("x", "y")))

    discard(scan.spark, listed, few, deep, pivoted, compared, more, known, rest, apart, *raw)

    of_set = sets.select("n", "a", "b", "doc").join(found.withColumnRenamed("node", "doc"), "doc", "left").select("n", "a", "b", F.coalesce("component", "doc").alias("component"))
    bare = sketched.drop("sketch")  # rows of a hot set are many, but each meets one row; texts without words meet none
    rows = bare.where("n > 0").join(of_set, ["n", "a", "b"], "left").unionByName(bare.where("n = 0").withColumn("component", F.col("doc_id")))
    return scan, rows.select("pid", "pos", "doc_id", "n", F.coalesce("component", "doc_id").alias("component"), *["key"] * by_row)


def dedup(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each document; see near_duplicates."""
    _, rows = near_duplicates(docs, k, percent)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), (F.col("doc_id") == F.col("component")).alias("kept"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without all but the first row of each component: of the least doc_id, null ids last.

    Rows are linked by their texts alone, so rows that share a doc_id, or have none, go only where they are copies.
    """
    scan, rows = near_duplicates(docs, k, percent, by_row=True)
    first = F.min(F.struct(F.col("key").isNull().alias("last"), "key", "pid", "pos")).alias("at")
    stay = rows.groupBy("component").agg(first).select("at.pid", "at.pos")
    side = write_side(stay, "kept", scan)

    def step(pid, batches, side):
        table = side("pos")
        keep = np.sort(table.column("pos").to_numpy()) if table else np.zeros(0, np.int64)
        pos = 0
        for batch in batches:
            at = np.arange(pos, pos + batch.num_rows)
            pos += batch.num_rows
            yield pa.RecordBatch.from_struct_array(batch.column("row")).filter(pa.array(np.isin(at, keep)))

    return scan.scan(step, docs.schema, None, side)
