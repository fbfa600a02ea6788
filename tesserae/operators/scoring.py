"""Rule-based scoring of completions against typed gold strings, as expressions over the box's content."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions import text as T

NO_BOX = -0.5


def grade_multiple(pred: Column, gold: Column, mode: str = "partial_penalty", wrong_weight: float = 0.5) -> Column:
    right, n_pred, n_gold = F.size(F.array_intersect(pred, gold)), F.size(pred), F.size(gold)
    if mode == "exact":
        return F.when((right == n_gold) & (n_pred == n_gold), 1.0).otherwise(0.0)
    if mode == "f1":
        return F.when((n_pred == 0) & (n_gold == 0), 1.0).when(right == 0, 0.0).otherwise(2.0 * right / (n_pred + n_gold))
    return F.when(n_gold == 0, 0.0).otherwise(F.greatest(F.lit(0.0), (right - wrong_weight * (n_pred - right)) / F.nullif(n_gold, F.lit(0))))


def _synonyms() -> dict[str, list[str]]:
    """Each normalised word of a group of synonyms with the whole group; no word is in two groups."""
    groups = [[re.sub(T.ANSWER_PUNCTUATION, "", w.strip().lower()) for w in g] for g in T.SYNONYMS]
    words = {w: g for g in groups for w in g}
    if len(words) != sum(map(len, groups)):
        raise ValueError("a word is in two groups of synonyms")
    return words


_SYNONYMS = _synonyms()


def alternatives(blank: Column) -> Column:
    """The whole, its parts between slashes, and synonyms of these, which are looked up in a map of literals."""
    own = F.filter(F.array_distinct(F.concat(F.array(T.answer_norm(blank)), F.transform(F.split(blank, "[/／]"), T.answer_norm))), lambda x: x != "")
    groups = F.create_map(*[x for w, g in _SYNONYMS.items() for x in (F.lit(w), F.array(*map(F.lit, g)))])
    known = F.filter(own, lambda w: w.isin(*_SYNONYMS))
    return F.when(F.size(known) == 0, own).otherwise(F.array_union(own, F.flatten(F.transform(known, lambda w: F.element_at(groups, w)))))


def rule_reward(expected: Column, completion: Column, boxed: Column, mode: str = "partial_penalty", wrong_weight: float = 0.5) -> Column:
    """The score of one completion; boxed is the content of its last box (null: none)."""
    kind = F.regexp_extract(expected, r"(?U)^\s*\[(\w+)\]", 1)
    gold = T.stripped(T.gold_payload(expected))
    same = F.when(F.array_sort(T.letters(boxed)) == F.array_sort(T.letters(gold)), 1.0).otherwise(0.0)
    blanks = F.split(gold, r"\|\|\|")
    given = F.filter(F.split(boxed, "[;；\n]"), lambda p: T.stripped(p) != "")
    fill = F.size(F.filter(F.sequence(F.lit(1), F.size(blanks)), lambda i: (i <= F.size(given)) & F.array_contains(alternatives(F.element_at(blanks, i)), T.answer_norm(F.get(given, i - 1))))) / F.size(blanks)
    points = F.filter(blanks, lambda k: T.answer_norm(k) != "")
    seen = F.concat_ws("|", T.answer_norm(boxed), T.answer_norm(completion))
    short = F.coalesce(F.size(F.filter(points, lambda k: F.exists(alternatives(k), lambda a: F.contains(seen, a)))) / F.nullif(F.size(points), F.lit(0)), F.lit(0.0))
    return (
        F.when(boxed.isNull(), NO_BOX).when(kind == "", F.when(T.answer_norm(boxed) == T.answer_norm(expected), 1.0).otherwise(0.0))
        .when(kind.isin("single", "bool"), same).when(kind == "multiple", grade_multiple(T.letters(boxed), T.letters(gold), mode, wrong_weight))
        .when(kind == "fill", fill).when(kind == "short", short).otherwise(0.0)
    )


def score(rows: DataFrame, mode: str = "partial_penalty", wrong_weight: float = 0.5) -> DataFrame:
    """rows (expected_answer, completion and others) with `reward`."""
    with_box = rows.withColumn("_box", T.boxed("completion"))
    return with_box.withColumn("reward", rule_reward(F.col("expected_answer"), F.col("completion"), F.col("_box"), mode, wrong_weight)).drop("_box")


def judged_or_rule(judge: Column, rule: Column, expected: Column) -> Column:
    """Short answers take the judge's score where there is one; all else the rule's."""
    return F.when(T.gold_type(expected) == "short", F.coalesce(judge, rule)).otherwise(rule)


def attacks(rows: DataFrame) -> DataFrame:
    """row_id, attack, completion, reward: completions that a scorer shouldn't reward, with what it gives.

    All keywords, the shortest of their alternatives (the first of equals), the question, and a single keyword alone.
    """
    gold = T.stripped(T.gold_payload(F.col("expected_answer")))
    parts = F.filter(F.transform(F.split(gold, r"\|\|\|"), lambda p: F.filter(F.transform(F.split(p, "[/／]"), T.stripped), lambda x: x != "")), lambda p: F.size(p) > 0)
    firsts, every = F.transform(parts, lambda p: F.element_at(p, 1)), F.flatten(parts)
    shortest = F.array_min(F.transform(every, lambda x, i: F.struct(F.length(T.answer_free(x)).alias("n"), i.alias("i"), x.alias("x")))).x
    boxed = lambda c: F.concat(F.lit("\\boxed{"), c, F.lit("}"))
    attack = lambda name, c: F.struct(F.lit(name).alias("attack"), boxed(c).alias("completion"))
    made = F.array_compact(F.array(
        attack("keyword_stuffing", F.array_join(firsts, "; ")), attack("shortest_keypoint", F.coalesce(shortest, F.lit(""))), attack("question_copy", F.coalesce("query", F.lit(""))),
        F.when(F.size(firsts) == 1, attack("bare_singleton", F.get(firsts, 0))),
    ))
    return score(rows.select("row_id", "expected_answer", F.explode(made).alias("a")).select("row_id", "expected_answer", "a.attack", "a.completion")).drop("expected_answer")
