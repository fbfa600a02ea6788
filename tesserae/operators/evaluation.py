"""Evaluation analytics: metric blocks, slices, paired changes, gates, cross tables, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators.sampling import quantile_numbered


def clipped(reward: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), reward.cast("double")))


def metric_columns(reward: str = "reward", where: Column | None = None) -> list[Column]:
    """count, accuracy, mean_reward, perfect_count, perfect_rate; zero where there is no row."""
    keep = F.lit(True) if where is None else where
    r = F.when(keep, F.col(reward).cast("double"))
    n, perfect = F.count(r), F.count_if(clipped(r) >= 1.0)
    zero = F.lit(0.0)
    return [n.alias("count"), F.coalesce(F.round(F.avg(clipped(r)), 6), zero).alias("accuracy"), F.coalesce(F.round(F.avg(r), 6), zero).alias("mean_reward"), perfect.alias("perfect_count"), F.coalesce(F.round(perfect / F.nullif(n, F.lit(0)), 6), zero).alias("perfect_rate")]


def metrics(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(*metric_columns())


def metrics_with_total(rows: DataFrame, by: str) -> DataFrame:
    """metrics by a column and, with a null there, over all rows, in one pass."""
    return rows.rollup(by).agg(*metric_columns())


def slice_metrics(rows: DataFrame, slices: dict[str, Column]) -> DataFrame:
    """Metrics of slices that may overlap."""
    named = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in slices.items()]))
    return rows.withColumn("slice", F.explode(named)).groupBy("slice").agg(*metric_columns())


def retrieval_summary(rows: DataFrame, *by: str) -> DataFrame:
    c = F.col("search_count")
    return rows.groupBy(*by).agg(*metric_columns(), F.count_if(c > 0).alias("retrieval_count"), F.round(F.avg(c), 6).alias("average_searches"), F.count_if(c == 1).alias("one_search_count"), F.count_if(c == 2).alias("two_search_count"), F.count_if("protocol_error").alias("error_count"), F.count_if(~F.col("terminated")).alias("unterminated_count"))


def paired_changes(baseline: DataFrame, candidate: DataFrame, by: str = "question_type", epsilon: float = 1e-9) -> DataFrame:
    """Grouped changes of two runs over the same rows (row_index, reward, response, by)."""
    b = baseline.select("row_index", by, F.col("reward").alias("rb"), F.col("response").alias("sb"))
    c = candidate.select("row_index", F.col("reward").alias("rc"), F.col("response").alias("sc"))
    d = F.col("rc") - F.col("rb")
    return b.join(c, "row_index").groupBy(by).agg(
        F.round(F.avg(d), 6).alias("mean_reward_delta"), F.count_if(d > epsilon).alias("gain_count"), F.count_if(d < -epsilon).alias("loss_count"),
        F.count_if((F.col("rb") < 1) & (F.col("rc") >= 1)).alias("perfect_gain_count"), F.count_if((F.col("rb") >= 1) & (F.col("rc") < 1)).alias("perfect_loss_count"),
        F.count_if(~F.col("sb").eqNullSafe(F.col("sc"))).alias("response_change_count"),
    )


def unpaired_keys(baseline: DataFrame, candidate: DataFrame, key: str = "row_index") -> DataFrame:
    """Keys that one side lacks."""
    b, c = baseline.select(F.col(key).alias("b")), candidate.select(F.col(key).alias("c"))
    return b.join(c, F.col("b") == F.col("c"), "full_outer").where("b is null or c is null").select(F.coalesce("b", "c").alias(key), F.when(F.col("b").isNull(), "candidate").otherwise("baseline").alias("side"))


def gate(summaries: DataFrame, baseline: str, least_gain: float = 0.0) -> DataFrame:
    """Each run's criteria against the baseline, and the run that is best among those that pass.

    summaries has run, accuracy, perfect_count, step; best is by accuracy, perfect rows and the earliest step. The query
    fails if the baseline is missing or there twice.
    """
    base = summaries.where(F.col("run") == baseline).agg(F.count(F.lit(1)).alias("_n"), F.max("accuracy").alias("a0"), F.max("perfect_count").alias("p0"))
    one = F.when(F.col("_n") == 1, F.col("a0")).otherwise(F.raise_error(F.concat(F.lit(f"baseline {baseline}: rows "), F.col("_n").cast("string"))).cast("double"))
    rows = summaries.where(F.col("run") != baseline).crossJoin(F.broadcast(base.select(one.alias("a0"), "p0")))
    rows = rows.withColumn("passed", (F.col("accuracy") >= F.col("a0") + least_gain) & (F.col("perfect_count") >= F.col("p0")))
    best = rows.where("passed").agg(F.max_by("run", F.struct("accuracy", "perfect_count", -F.col("step"))).alias("best"))
    return rows.crossJoin(F.broadcast(best)).select("run", "step", "accuracy", "perfect_count", "passed", F.coalesce(F.col("run") == F.col("best"), F.lit(False)).alias("is_best"))


def counts(rows: DataFrame, *keys: str) -> DataFrame:
    """key, n by composite keys joined with colons."""
    return rows.groupBy(F.concat_ws(":", *[F.col(k).cast("string") for k in keys]).alias("key")).agg(F.count(F.lit(1)).alias("n"))


def rates(rows: DataFrame, column: str) -> DataFrame:
    n = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return n.select(column, "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("rate"))


def cross_table(rows: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    return rows.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).na.fill(0)


def reward_distribution(rows: DataFrame) -> DataFrame:
    return rows.groupBy("reward").agg(F.count(F.lit(1)).alias("n"))


def extremes(rows: DataFrame, n: int) -> DataFrame:
    """n rows from both ends of the rewards (and the middle one if n is odd), with their place idx from 1.

    Only the ends are ranked, so no task sorts more than its own part and the few rows left of others; the middle one is
    found by its place among buckets of rewards.
    """
    half = n // 2
    high = rows.orderBy(F.desc("reward"), "idx").limit(half)
    low = rows.orderBy("reward", F.desc("idx")).limit(half)
    picked = high.unionByName(low)
    if n % 2:
        placed = quantile_numbered(rows.withColumn("_r", -F.col("reward").cast("double")), "_r", "idx", "_place")
        middle = rows.agg((F.floor(F.count(F.lit(1)) / 2) + 1).alias("_middle"))
        picked = picked.unionByName(placed.join(F.broadcast(middle), F.col("_place") == F.col("_middle")).select(*rows.columns))
    return picked.dropDuplicates(["idx"])


def pages(rows: DataFrame, size: int = 64, by: str = "idx") -> DataFrame:
    """page, pages, n, first, last of rows numbered from 1 by an existing index."""
    total = rows.agg(F.max(by).alias("m"))
    page = F.floor((F.col(by) - 1) / size)
    return rows.groupBy(page.alias("page")).agg(F.count(F.lit(1)).alias("n"), F.min(by).alias("first"), F.max(by).alias("last")).crossJoin(F.broadcast(total)).select("page", F.ceil(F.col("m") / size).alias("pages"), "n", "first", "last")


def weighted_accuracy(rows: DataFrame) -> Column:
    return F.sum(F.col("accuracy") * F.col("count")) / F.nullif(F.sum("count"), F.lit(0))


def differences(a: DataFrame, b: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """key, a, b, change: entries of two flat maps that differ."""
    x, y = a.select(F.col(key), F.col(value).alias("a")), b.select(F.col(key), F.col(value).alias("b"))
    change = F.when(F.col("b").isNull(), "only_a").when(F.col("a").isNull(), "only_b").otherwise("changed")
    return x.join(y, key, "full_outer").where("not (a <=> b)").select(key, "a", "b", change.alias("change"))
