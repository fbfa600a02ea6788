"""Deterministic splitting, balancing, oversampling and curricula by hash order.

A rank within a stratum is needed only up to a bound wherever one is known; Spark then cuts each partition's
rows to that bound before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tesserae.functions import text as T


def numbered(rows: DataFrame, strata: list[str], order: Column, bucket: Column, name: str) -> DataFrame:
    """rows with their place (from 1) by `order` within their stratum, however large it is.

    bucket is a number that doesn't fall as order rises. Rows are ranked within a bucket, and the sizes of the
    buckets before it are added, so no task sorts more than one bucket.
    """
    held = rows.withColumn("_b", bucket)
    sizes = held.groupBy(*strata, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*strata).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(*[F.col(s).alias(f"_s{i}") for i, s in enumerate(strata)], F.col("_b").alias("_c"), F.coalesce(before, F.lit(0)).alias("_before"))
    same = F.col("_b") == F.col("_c")
    for i, s in enumerate(strata):
        same = same & F.col(s).eqNullSafe(F.col(f"_s{i}"))
    ranked = held.withColumn("_r", F.row_number().over(Window.partitionBy(*strata, "_b").orderBy(order)))
    return ranked.join(offsets, same).select(*rows.columns, (F.col("_r") + F.col("_before")).alias(name))


def quantile_numbered(rows: DataFrame, value: str, key: str, name: str, parts: int = 64) -> DataFrame:
    """rows with their place (from 1) by a numeric column and key, in buckets cut at approximate quantiles."""
    cuts = rows.agg(F.percentile_approx(value, [i / parts for i in range(1, parts)]).alias("_cuts"))  # one row of parts - 1 numbers
    held = rows.crossJoin(F.broadcast(cuts))
    bucket = F.size(F.filter("_cuts", lambda c: c < F.col(value)))
    return numbered(held, [], F.struct(value, key), bucket, name).drop("_cuts")


def ordered(rows: DataFrame, strata: list[str], key: str, name: str, parts: int = 64) -> DataFrame:
    """rows with their place (from 1) by key within their stratum: numbers in buckets cut at approximate quantiles of all
    rows, texts in buckets of their first three characters."""
    if isinstance(rows.schema[key].dataType, NumericType):
        cuts = rows.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)]).alias("_cuts"))
        return numbered(rows.crossJoin(F.broadcast(cuts)), strata, F.col(key), F.size(F.filter("_cuts", lambda c: c < F.col(key))), name).drop("_cuts")
    first = sum(F.ascii(F.substring(key, i + 1, 1)).cast("long") * (1 << 21 * (2 - i)) for i in range(3))
    return numbered(rows, strata, F.col(key), first, name)


def _leading(digest: Column) -> Column:
    """The first three hexadecimal digits of a hash: 4,096 buckets of like size."""
    return F.conv(F.substring(digest, 1, 3), 16, 10).cast("int")


def hash_ranked(rows: DataFrame, strata: list[str], seed: int, key: str) -> DataFrame:
    """rows with `position` in hash order within their stratum; a stratum may be most of the rows."""
    digest = T.hash_key(F.lit(seed), *strata_cols(strata), F.col(key))
    return numbered(rows.withColumn("_digest", digest), strata, F.struct("_digest", key), _leading(F.col("_digest")), "position").drop("_digest")


def strata_cols(strata: list[str]) -> list[Column]:
    return [F.col(c) for c in strata]


def stratified_split(rows: DataFrame, strata: list[str], key: str, validation: float = 0.1, holdout: float = 0.1, seed: int = 7, least: int = 7) -> DataFrame:
    """rows with `split`: in hash order the first are validation, then rl_holdout, the rest train.

    Shares are rounded half to even; strata of `least` rows have one row of each at least; train keeps one at
    least, at the cost of rl_holdout first.
    """
    n = rows.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n"))
    v, h = (F.bround(F.col("_n") * share).cast("long") for share in (validation, holdout))
    v, h = (F.when(F.col("_n") >= least, F.greatest(x, F.lit(1))).otherwise(x) for x in (v, h))
    n = n.withColumns({"_v": v, "_h": h})
    n = n.withColumn("_h", F.greatest(F.lit(0), F.least(F.col("_h"), F.col("_n") - 1 - F.col("_v"))))
    n = n.withColumn("_v", F.greatest(F.lit(0), F.least(F.col("_v"), F.col("_n") - 1 - F.col("_h"))))
    ranked = hash_ranked(rows, strata, seed, key).join(n, strata)
    split = F.when(F.col("position") <= F.col("_v"), "validation").when(F.col("position") <= F.col("_v") + F.col("_h"), "rl_holdout").otherwise("train")
    return ranked.withColumn("split", split).drop("_n", "_v", "_h")


def source_split(source: Column, parts: int = 8) -> Column:
    """validation for one source in `parts` by hash."""
    return F.when(F.conv(F.substring(F.sha2(source, 256), 1, 8), 16, 10).cast("long") % parts == 0, "validation").otherwise("train")


def first_per(rows: DataFrame, strata: list[str], n: int, key: str, seed: int = 7) -> DataFrame:
    order = Window.partitionBy(*strata).orderBy(T.hash_key(F.lit(seed), *strata_cols(strata), F.col(key)), key)
    return rows.withColumn("position", F.row_number().over(order)).where(F.col("position") <= n)  # cut to n before the shuffle


def balanced_count(available: int, open_rows: int, kinds: int, target: float, least: float, most: float) -> int:
    """How many rows of each kind bring their share nearest to target within bounds; smaller counts win ties."""
    shares = [(abs(c * kinds / (c * kinds + open_rows) - target), c) for c in range(1, available + 1) if least <= c * kinds / (c * kinds + open_rows) <= most]
    if not shares:
        raise ValueError("no count gives a share within the bounds")
    return min(shares)[1]


def balanced_replay(objective: DataFrame, kinds: list[str], open_rows: int, target: float = 0.25, least: float = 0.15, most: float = 0.35, seed: int = 7, key: str = "fingerprint") -> DataFrame:
    """The same number of rows of each kind, in hash order, such that replay makes the target share."""
    counts = {r["kind"]: r["n"] for r in objective.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = balanced_count(min(counts.get(k, 0) for k in kinds), open_rows, len(kinds), target, least, most)
    return first_per(objective.where(F.col("kind").isin(*kinds)), ["kind"], n, key, seed)


def oversampled(rows: DataFrame, times: Column) -> DataFrame:
    """Each row `times` times, with `exposure` from 0."""
    return rows.withColumn("exposure", F.explode(F.when(times > 0, F.sequence(F.lit(0), times.cast("int") - 1)).otherwise(F.array().cast("array<int>"))))


def cycled(rows: DataFrame, total: int, key: str) -> DataFrame:
    """`total` exposures of rows, in turn by key."""
    n = rows.agg(F.count(F.lit(1)).alias("_n"))
    slots = rows.sparkSession.range(total).crossJoin(F.broadcast(n)).select(F.col("id").alias("exposure"), (F.col("id") % F.nullif("_n", F.lit(0)) + 1).alias("_i"))
    return slots.join(ordered(rows, [], key, "_i"), "_i").drop("_i")


def weighted_order(rows: DataFrame, weight: Column, key: str, seed: int = 7) -> DataFrame:
    """Rows of positive weight with `draw`: weighted sampling without replacement, by u ** (1 / w) of a hash u."""
    u = (F.conv(F.substring(T.hash_key(F.lit(seed), F.col(key)), 1, 12), 16, 10).cast("double") + 1) / F.lit(float(16**12 + 1))
    drawn = rows.where(weight > 0).withColumn("_k", F.pow(u, 1.0 / weight))
    return quantile_numbered(drawn.withColumn("_k", -F.col("_k")), "_k", key, "draw").drop("_k")


def curriculum(pools: dict[str, tuple[DataFrame, int]], steps: int, seed: int, key: str) -> DataFrame:
    """step, slot, pool, key: for each step a fixed number of rows of each pool, in hash order, pools in turn.

    Steps take consecutive rows of a pool, so no step has a row twice unless its pool is smaller than its part.
    """
    out = None
    for name, (rows, per_step) in pools.items():
        if rows.isEmpty():
            raise ValueError(f"pool {name} is empty")
        n = rows.agg(F.count(F.lit(1)).alias("_n"))
        ranked = hash_ranked(rows.select(F.col(key).alias("key"), F.lit(name).alias("pool")), ["pool"], seed, "key")
        slots = rows.sparkSession.range(steps * per_step).crossJoin(F.broadcast(n)).select((F.expr(f"id div {per_step}") + 1).alias("step"), (F.col("id") % per_step).cast("int").alias("slot"), (F.col("id") % F.col("_n") + 1).alias("position"))
        part = slots.join(ranked, "position").select("step", "slot", "pool", "key")
        out = part if out is None else out.unionByName(part)
    return out


def _turns(rows: DataFrame, pool: str, seed: int, key: str, slots: DataFrame, offset: Column) -> DataFrame:
    """slots (step and others) with the row that stands at `offset` of the pool's hash order, which is gone round and round."""
    n = rows.agg(F.count(F.lit(1)).alias("_n"))
    ranked = hash_ranked(rows.withColumn("_pool", F.lit(pool)), ["_pool"], seed, key).drop("_pool")
    return slots.crossJoin(F.broadcast(n)).withColumn("position", offset % F.nullif("_n", F.lit(0)) + 1).join(ranked, "position").drop("position", "_n")


def short_curriculum(holdout: DataFrame, objective: DataFrame, steps: int, seed: int = 42) -> DataFrame:
    """step, slot, row_id, minimum_searches: for each step an objective, a fill and a short question and a bonus.

    holdout has row_id, kind (fill or short) and search_turns, objective row_id; they must have no row in common. The
    bonus is a question of two searches in odd steps and any open one in even ones, other than the step's fill and
    short questions; where the first three choices are these, one of all open questions.
    """
    both = holdout.select("row_id").join(objective.select("row_id"), "row_id", "left_semi")
    if not both.isEmpty():
        raise ValueError("holdout and objective rows overlap")
    step = holdout.sparkSession.range(1, steps + 1).select(F.col("id").alias("step"))
    own = holdout.select("row_id", "kind", F.col("search_turns").alias("minimum_searches"))
    parts = [_turns(objective.select("row_id", F.lit(0).alias("minimum_searches")), "objective", seed, "row_id", step, F.col("step") - 1).withColumn("slot", F.lit("objective"))]
    for kind in ("fill", "short"):
        parts.append(_turns(own.where(F.col("kind") == kind).drop("kind"), kind, seed, "row_id", step, F.col("step") - 1).withColumn("slot", F.lit(kind)))
    taken = parts[1].unionByName(parts[2]).select("step", "row_id")
    choice = step.withColumn("o", F.explode(F.array(*map(F.lit, range(3)))))
    at = F.floor((F.col("step") - 1) / 2) * 3 + F.col("o")
    two = _turns(own.where("minimum_searches = 2").drop("kind"), "two_search", seed, "row_id", choice.where("step % 2 = 1"), at).withColumn("rank", F.lit(0))
    open_ = _turns(own.drop("kind"), "open", seed, "row_id", choice, at).withColumn("rank", F.when(F.col("step") % 2 == 1, 1).otherwise(0))
    free = two.unionByName(open_).join(taken, ["step", "row_id"], "left_anti")
    bonus = free.groupBy("step").agg(F.min_by(F.struct("row_id", "minimum_searches"), F.struct("rank", "o")).alias("r")).select("step", "r.*")
    parts.append(bonus.withColumn("slot", F.when(F.col("minimum_searches") == 2, "two_search").otherwise("open")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("step", "slot", "row_id", "minimum_searches")


def balanced_curriculum(objective: DataFrame, fill: DataFrame, short: DataFrame, steps: int, prompts: int, seed: int, key: str) -> DataFrame:
    """curriculum of half objective, a quarter fill and a quarter short questions, no question twice in a step."""
    if prompts <= 0 or prompts % 4:
        raise ValueError("prompts of a step must be divisible by four")
    parts = {"objective": (objective, prompts // 2), "fill": (fill, prompts // 4), "short": (short, prompts // 4)}
    for name, (rows, n) in parts.items():
        if rows.select(key).distinct().limit(n).count() < n:
            raise ValueError(f"not enough {name} questions for a step")
    return curriculum({name: (rows.dropDuplicates([key]), n) for name, (rows, n) in parts.items()}, steps, seed, key)


def review_sample(rows: DataFrame, critical: Column, categories: Column, per_category: int, key: str) -> DataFrame:
    """All critical rows and the first of each category by key, each once."""
    own = rows.where(critical).select(key)
    tagged = rows.select(key, F.explode(categories).alias("_c"))
    first = tagged.withColumn("_r", F.row_number().over(Window.partitionBy("_c").orderBy(key))).where(F.col("_r") <= per_category).select(key)
    return rows.join(own.unionByName(first).distinct(), key, "left_semi")
