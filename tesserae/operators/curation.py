"""Cleaning of question rows and conversations: validation, duplicates, decontamination, weights, leaks."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType

from tesserae.functions import text as T
from tesserae.operators.sampling import quantile_numbered


def issues(*tests: tuple[Column, str]) -> Column:
    """The names of all tests that hold."""
    return F.array_compact(F.array(*[F.when(test, name) for test, name in tests]))


def first_reason(*tests: tuple[Column, str]) -> Column:
    out = F.lit(None).cast("string")
    for test, name in reversed(tests):
        out = F.when(test, name).otherwise(out)
    return out


def options(query: Column) -> Column:
    return F.regexp_extract_all(query, F.lit(r"(?m)^\s*([A-L])\s*[.．、:：]\s*(.+?)\s*$"), F.lit(1))


def structure(rows: DataFrame) -> DataFrame:
    """rows (row_id, query, expected_answer, bank) with type, question_key, expected_key, issues, fatal_issues."""
    query, expected = T.stripped(F.coalesce("query", F.lit(""))), T.stripped(F.coalesce("expected_answer", F.lit("")))
    kind, points, opts = T.gold_type(expected), F.size(T.keypoints(expected)), options(query)
    got = T.letters(T.gold_payload(expected))
    objective = kind.isin("single", "bool", "multiple")
    fatal = issues(
        (query == "", "missing_query"), (expected == "", "missing_expected_answer"), (~kind.isin("single", "bool", "multiple", "fill", "short"), "invalid_answer_type"),
        (objective & (F.size(opts) == 0), "missing_options"), (objective & (F.size(got) == 0), "missing_answer_letters"),
        (kind.isin("single", "bool") & (F.size(got) != 1), "non_unique_objective_answer"),
        (objective & (F.size(opts) > 0) & (F.size(F.array_except(got, opts)) > 0), "answer_letter_out_of_range"),
        ((kind == "fill") & (points == 0), "empty_fill_answer"), ((kind == "short") & (points == 0), "empty_short_keypoints"),
    )
    blanks = F.size(F.array_distinct(F.regexp_extract_all(query, F.lit(r"[\[【(（]\s*空?\s*(\d+)\s*[\]】)）]"), F.lit(1))))
    soft = issues(((kind == "fill") & (blanks > 0) & (blanks != points), "fill_blank_count_mismatch"))
    key = T.evidence_norm(F.concat_ws("|", F.coalesce("bank", F.lit("")), T.question_context(query), F.array_join(opts, "|")))
    return rows.withColumns({"type": kind, "question_key": key, "expected_key": T.evidence_norm(expected), "issues": soft, "fatal_issues": fatal})


def duplicate_policy(rows: DataFrame) -> DataFrame:
    """rows (row_id, question_key, expected_key) with duplicate_group, duplicate_group_size, duplicate_of, conflict.

    Groups of one key with different answers are conflicts as a whole; else the least row id stays. Groups are
    numbered by their least (numeric) row id; empty keys make no group. Keys are aggregated before they are joined, so a
    hot key costs its rows one small join row, not a window.
    """
    keyed = rows.where("question_key <> ''").groupBy("question_key").agg(F.count(F.lit(1)).alias("size"), F.min("row_id").alias("least"), (F.min("expected_key") != F.max("expected_key")).alias("clash"))
    groups = quantile_numbered(keyed.where("size > 1"), "least", "question_key", "duplicate_group").withColumn("duplicate_group", F.col("duplicate_group").cast("int"))
    joined = rows.join(groups, "question_key", "left")
    return joined.select(
        *[F.col(c) for c in rows.columns], "duplicate_group", F.coalesce("size", F.lit(1).cast("long")).alias("duplicate_group_size"),
        F.when(~F.col("clash") & (F.col("row_id") != F.col("least")), F.col("least")).alias("duplicate_of"), F.coalesce("clash", F.lit(False)).alias("conflict"),
    )


def sample_weight(fatal: Column, duplicate_of: Column, kind: Column, support: Column) -> Column:
    open_ = F.when(support == "full", 3.0).when(support == "partial", 2.0).when(support == "none", 0.25).otherwise(0.0)
    return F.when(fatal | duplicate_of.isNotNull(), 0.0).when(kind.isin("fill", "short"), open_).otherwise(1.0)


def without(rows: DataFrame, excluded: list[DataFrame], key: str) -> DataFrame:
    """rows whose key is in none of the tables."""
    every = excluded[0].select(key)
    for e in excluded[1:]:
        every = every.unionByName(e.select(key))
    return rows.join(every.distinct(), key, "left_anti")


def canonical(rows: DataFrame, key: str = "fingerprint", answer: str = "answer") -> DataFrame:
    """One row for each key: its least row id; keys with more than one answer go as a whole."""
    return rows.groupBy(key).agg(F.min("row_id").alias("row_id"), F.count(F.lit(1)).alias("n"), F.min(answer).alias("_lo"), F.max(answer).alias("_hi")).where("_lo = _hi").drop("_lo").withColumnRenamed("_hi", answer)


def split_overlaps(rows: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Keys that are in more than one split."""
    return rows.groupBy(key).agg(F.count_distinct("split").alias("splits")).where("splits > 1")


def assert_isolated(rows: DataFrame, key: str = "fingerprint") -> None:
    if not split_overlaps(rows, key).isEmpty():
        raise ValueError(f"a {key} is in more than one split")


def message_issues(messages: Column) -> Column:
    """Order, content and action checks of an array of (role, content)."""
    n = F.size(messages)
    at = lambda i: F.try_element_at(messages, F.lit(i))
    by_index = F.flatten(F.transform(messages, lambda m, i: issues(
        (T.stripped(F.coalesce(m.content, F.lit(""))) == "", F.concat(F.lit("invalid_content:"), i.cast("string"))),
        ((i >= 2) & (m.role != F.when(i % 2 == 0, "assistant").otherwise("environment")), F.concat(F.lit("role_order:"), i.cast("string"))),
        ((i > 1) & (m.role == "environment") & ~m.content.startswith("[检索结果]"), F.concat(F.lit("invalid_observation:"), i.cast("string"))),
    )))
    inner = F.filter(F.slice(messages, F.lit(3), F.greatest(n - 3, F.lit(0))), lambda m: (m.role == "assistant") & (F.coalesce(T.search_query(m.content), F.lit("")) == ""))
    every = F.concat(
        issues((at(1).role != "system", "missing_system"), (at(2).role != "user", "missing_initial_user"), (at(-1).role != "assistant", "last_message_not_assistant")),
        by_index, F.transform(inner, lambda m: F.lit("invalid_search_action")), issues((~F.contains(at(-1).content, F.lit("\\boxed{")), "missing_boxed_answer")),
    )
    return F.when(n < 3, F.array(F.lit("too_few_messages"))).otherwise(every)


def last_of_role(messages: Column, role: str) -> Column:
    return F.try_element_at(F.filter(messages, lambda m: m.role == role), F.lit(-1)).content


def leaked_points(query: Column, original: Column, points: Column) -> Column:
    """Indexes of points with an alternative in the query that the original lacks."""
    all_ = F.when(F.size(points) > 0, F.sequence(F.lit(0), F.size(points) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(all_, lambda i: F.exists(F.element_at(points, i + 1), lambda a: F.contains(query, a) & ~F.contains(original, a)))


def query_rejection(query: Column, first: Column, context: Column, points: Column) -> Column:
    """Why a rewritten query is refused, or null."""
    own, seen = F.array_distinct(T.tokens(query)), T.tokens(context)
    return first_reason(
        (T.stripped(query) == "", "empty"), (F.length(query) > 256, "too_long"), (T.answer_free(query) == T.answer_free(first), "duplicate"),
        (F.size(T.keypoint_hits(T.answer_free(query), points)) > F.size(T.keypoint_hits(T.answer_free(context), points)), "answer_leak"),
        (F.size(F.array_except(own, seen)) > 2, "unsupported_terms"), (F.size(F.array_intersect(own, seen)) == 0, "ungrounded"),
    )


@F.pandas_udf(BooleanType())
def near_duplicate(a: pd.Series, b: pd.Series) -> pd.Series:
    """Equal, one in the other (three characters at least), or a matching ratio of 0.88 (four at least)."""

    def one(x, y):
        if not x or not y:
            return False
        short = min(len(x), len(y))
        return x == y or (short >= 3 and (x in y or y in x)) or (short >= 4 and difflib.SequenceMatcher(None, x, y).ratio() >= 0.88)

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])


def near_candidates(names: DataFrame) -> DataFrame:
    """x, y (x < y): pairs of names (k, a; each a once) that near_duplicate can link, without loss.

    A name within another has all its trigrams there, so its rarest one is looked up. A ratio of 0.88 over S characters
    takes 0.44 S matching ones in 0.12 S + 1 runs at most, so 0.32 S - 1 bigrams (counted as often as they come) are
    common, 4/7 of a name's own length less 1 at least; so two names share one of the rarest bigrams of each, the last of
    these left out.
    """
    length = F.length("a").alias("l")
    runs = lambda q: F.transform(F.sequence(F.lit(1), F.length("a") - q + 1), lambda i: F.substring(F.col("a"), i, F.lit(q)))
    ordered = [F.least("xk", "yk").alias("x"), F.greatest("xk", "yk").alias("y")]
    side = lambda df, c: df.select("g", F.col("k").alias(f"{c}k"), F.col("l").alias(f"{c}l"))

    tri = names.where(F.length("a") >= 3).select("k", length, F.explode(F.array_distinct(runs(3))).alias("g"))
    rarest = tri.join(tri.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "g").groupBy("k", "l").agg(F.min(F.struct("n", "g")).alias("m")).select("k", "l", "m.g")
    within = side(rarest, "x").join(side(tri, "y"), "g").where("xl < yl").select(*ordered)

    bi = names.where(F.length("a") >= 4).select("k", length, F.explode(runs(2)).alias("b")).groupBy("k", "l", "b").agg(F.count(F.lit(1)).alias("c"))
    bi = bi.select("k", "l", F.explode(F.sequence(F.lit(1).cast("long"), "c")).alias("i"), "b").select("k", "l", F.struct("b", "i").alias("g"))
    ranked = bi.join(bi.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "g").withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("n", "g")))
    rare = ranked.where("r <= l - greatest(1, ceil(4 * l / 7 - 1 - 1e-9))")
    alike = side(rare, "x").join(side(rare, "y"), "g").where("xk < yk and 44 * (xl + yl) <= 100 * least(xl, yl)").select(*ordered)
    return within.unionByName(alike).distinct()


def near_classes(rows: DataFrame, key: str, name: str) -> DataFrame:
    """key, name_class, class_id for each row: the least key of its name, and of all names linked to it.

    Equal names are one class; different ones are linked by near_duplicate (the name of the least key first, as the
    reference's pairs stand) and what links to it. Null and empty names are linked with nothing. Keys are unique.
    """
    from tesserae.llm.common import stored
    from tesserae.llm.components import components

    names = stored(rows.where(F.col(name) != "").groupBy(F.col(name).alias("a")).agg(F.min(key).alias("k")), "names")
    of = lambda c, a: names.select(F.col("k").alias(c), F.col("a").alias(a))
    links = near_candidates(names).join(of("x", "a"), "x").join(of("y", "b"), "y").where(near_duplicate("a", "b")).select("x", "y")
    classed = names.join(components(links).withColumnRenamed("node", "k"), "k", "left").select(F.col("a").alias(name), F.col("k").alias("name_class"), F.coalesce("component", "k").alias("class_id"))
    return rows.select(key, name).join(classed, name, "left").select(key, F.coalesce("name_class", key).alias("name_class"), F.coalesce("class_id", key).alias("class_id"))


@F.pandas_udf(DoubleType())
def overlap_ratio(value: pd.Series, context: pd.Series) -> pd.Series:
    """1 if contained, else the longest common block as a share of value."""

    def one(v, c):
        if not v or c is None:
            return 0.0
        return 1.0 if v in c else difflib.SequenceMatcher(None, v, c).find_longest_match(0, len(v), 0, len(c)).size / len(v)

    return pd.Series([one(v, c) for v, c in zip(value, context, strict=True)])


#: Bytes of short items that one broadcast holds; more of them are looked for slice by slice.
SLICE_BYTES = 32 << 20


def contained_items(docs: DataFrame, items: DataFrame, limit: int = SLICE_BYTES) -> DataFrame:
    """doc_id, item_id where a document's text contains an item's (item_id, text) as it is.

    Items and documents are cut at the same characters. All but the first and last word of an item stand whole in a
    document that contains it, so items are joined on the first three of these and confirmed. Items with fewer have
    no such key: they are broadcast in slices of at most about `limit` bytes and held against every text.
    """
    cut = F.split("text", r"[ \n]")
    split = items.select("item_id", F.col("text").alias("item"), cut.alias("w"))
    keyed = split.where("size(w) >= 5").select("item_id", "item", F.array_join(F.slice("w", 2, 3), " ").alias("k"))
    short = split.where("item is not null and size(w) < 5").select("item_id", "item")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.array_join(F.slice("w", i, 3), " ")))
    found = docs.select("doc_id", cut.alias("w")).where("size(w) >= 5").select("doc_id", F.explode(grams).alias("k"))
    hits = found.join(keyed, "k").select(F.col("doc_id").alias("d"), "item_id", "item").distinct()
    texts = docs.select("doc_id", "text")
    out = hits.join(texts, F.col("d").eqNullSafe(F.col("doc_id"))).where(F.contains("text", F.col("item"))).select("doc_id", "item_id")
    size = short.agg(F.sum(F.octet_length("item") + 16)).first()[0] or 0
    n = -(-size // limit)
    for i in range(n):
        part = short if n == 1 else short.where(F.pmod(F.xxhash64("item_id", "item"), F.lit(n)) == i)
        out = out.unionByName(texts.join(F.broadcast(part), F.contains("text", F.col("item"))).select("doc_id", "item_id"))
    return out


def objective_issues(query: Column, kind: Column, expected: Column) -> Column:
    letters, texts = options(query), F.regexp_extract_all(query, F.lit(r"(?m)^\s*[A-L]\s*[.．、:：]\s*(.+?)\s*$"), F.lit(1))
    return issues(
        (F.size(F.array_distinct(texts)) < F.size(texts), "duplicate_options"), ((kind == "single") & (F.size(letters) >= 6), "many_options_single"),
        ((kind == "multiple") & (F.size(T.letters(T.gold_payload(expected))) == 1), "single_letter_multiple"), (F.length(T.question_context(query)) < 6, "short_question"),
    )


def reason_counts(rows: DataFrame, column: str) -> DataFrame:
    """reason, n over arrays of reasons: reasons are counted, not rows."""
    return rows.select(F.explode(column).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
