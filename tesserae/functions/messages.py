"""Expressions over rendered observations, model texts and message arrays (role, content)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions import text as T

# Texts of the message protocol.
RESULTS_MARK = "[检索结果]"
NO_RESULTS = "[检索结果]\n未找到匹配文档。请改用更具体的设备、流程或规范关键词。"
MORE_SEARCHES = "\n\n还可检索 %d 次。证据不足时换更具体的关键词继续检索；证据足够时提交 \\boxed{...}。"
NO_MORE_SEARCHES = "\n\n检索次数已用完，下一轮必须提交 \\boxed{...}。"
GROUNDED, REASONED, GROUNDED_POINTS = "依据检索证据，", "分析后，", "依据检索证据，答案要点为："
QUERY_LABELS = r"(?i)^(?:query|search query|检索词|检索关键词|查询|关键词)\s*[：:]\s*"


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def observations(results: DataFrame, most: int = 1800) -> DataFrame:
    """query_id, observation, visible: results (query_id, rank, source, heading, raw_score, snippet) as one text.

    visible holds, in order of rank, (source, snippet as far as the cut text shows it, and the other columns of
    the result). Queries without a result have no row; NO_RESULTS is their observation.
    """
    others = [c for c in results.columns if c not in ("query_id", "rank")]
    found = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", *others))).alias("r"))
    safe = lambda s: F.replace(F.replace(s, F.lit("</search>"), F.lit("＜/search＞")), F.lit("<search"), F.lit("＜search"))

    def head(x, i):
        heading = F.when(F.coalesce(x.heading, F.lit("")) == "", "").otherwise(F.concat(F.lit(" · "), x.heading))
        return F.concat((i + 1).cast("string"), F.lit(". 来源："), F.coalesce(x.source, F.lit("")), heading, F.format_string("\n相关度：%.2f\n", x.raw_score))

    found = found.withColumn("heads", F.transform("r", head)).withColumn("cut", F.transform("r", lambda x: safe(x.snippet)))
    found = found.withColumn("blocks", F.zip_with("heads", "cut", lambda h, s: F.concat(h, s))).withColumn("observation", F.substring(F.concat_ws("\n\n", F.lit(RESULTS_MARK), "blocks"), 1, most))

    def shown(x, i):
        before = F.aggregate(F.slice("blocks", 1, i), F.lit(len(RESULTS_MARK) + 2), lambda n, b: n + F.length(b) + 2)
        room = F.length("observation") - before - F.length(F.get("heads", i))
        return x.withField("snippet", F.substring(F.get("cut", i), F.lit(1), F.greatest(room, F.lit(0))))

    return found.select("query_id", "observation", F.transform("r", shown).alias("visible"))


def guidance(remaining: Column) -> Column:
    return F.when(remaining > 0, F.format_string(MORE_SEARCHES, remaining)).otherwise(F.lit(NO_MORE_SEARCHES))


def visible_text(rendered: Column) -> Column:
    """A rendered observation without its mark, ranks and scores, so numbers can't match these."""
    lines = F.split(rendered, r"\r\n|\n|\r")
    return F.array_join(F.filter(lines, lambda x: (x != RESULTS_MARK) & ~x.rlike(r"^\d+\.\s+来源：") & ~x.startswith("相关度：")), "\n")


def rendered_sources(rendered: Column) -> Column:
    """Sources named by a rendered observation, each once, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(rendered, F.lit(r"(?m)^\d+\.\s+来源：(.+?)(?: · .*)?$"), F.lit(1)), T.stripped))


def boxed_response(expected: Column, grounded: bool) -> Column:
    """The canonical answer in a box after a lead; null where the gold string is unusable."""
    return F.concat(F.lit((GROUNDED if grounded else REASONED) + "\\boxed{"), T.canonical_answer(expected), F.lit("}"))


def points_response(points: Column) -> Column:
    """Two to six different points as a numbered list, in prose and in the box; else null."""
    own = F.filter(F.transform(points, T.stripped), lambda p: p != "")
    listed = F.array_join(F.transform(own, lambda p, i: F.concat((i + 1).cast("string"), F.lit(". "), p)), "；")
    good = F.size(own).between(2, 6) & (F.size(F.array_distinct(own)) == F.size(own))
    return F.when(good, F.concat(F.lit(GROUNDED_POINTS), listed, F.lit("\n\\boxed{"), listed, F.lit("}")))


def rebuilt_answer(points: Column) -> Column:
    """A short gold string of two to six points, none blank; else null."""
    own = F.transform(points, T.stripped)
    return F.when(F.size(own).between(2, 6) & ~F.exists(own, lambda p: p == ""), F.concat(F.lit("[short] "), F.array_join(own, " ||| ")))


def search_messages(instructions: str, query: Column, answer: Column, hops: Column) -> Column:
    """Messages of a trajectory: hops is an array of (query, observation), empty for an objective question."""
    left = F.size(hops)
    turns = F.flatten(F.transform(hops, lambda h, i: F.array(
        message("assistant", F.concat(F.lit("<search>"), h.query, F.lit("</search>"))), message("environment", F.concat(h.observation, guidance(F.lit(1) - i))),
    )))
    ends = F.array(message("system", F.lit(instructions)), message("user", query))
    return F.when(left > 0, F.concat(ends, turns, F.array(message("assistant", answer)))).otherwise(F.concat(ends, F.array(message("assistant", answer))))


def interleaved(responses: Column, observed: Column) -> Column:
    """Messages of responses and observations in turn; the longer array's rest stays."""
    return F.filter(F.flatten(F.zip_with(responses, observed, lambda r, o: F.array(message("assistant", r), message("environment", o)))), lambda m: m.content.isNotNull())


def role_text(messages: Column, role: str) -> Column:
    return F.array_join(F.transform(F.filter(messages, lambda m: (F.lower(m.role) == role) & m.content.isNotNull()), lambda m: m.content), "\n")


def search_turns(messages: Column) -> Column:
    return F.size(F.filter(messages, lambda m: m.role == "environment"))


def last_text(responses: Column) -> Column:
    """The last response that isn't blank, trimmed; else an empty text."""
    return F.coalesce(F.try_element_at(F.filter(F.transform(responses, T.stripped), lambda r: r != ""), F.lit(-1)), F.lit(""))


def until_search_close(response: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(response, r"(?is)^(.*?</search\s*>)", 1), F.lit("")), response)


def query_candidate(generated: Column) -> Column:
    """One query out of a model's text: its search action, else a JSON value's, else its last line without marks."""
    text = T.stripped(F.coalesce(generated, F.lit("")))
    bare = T.stripped(F.regexp_replace(F.element_at(F.split(text, "</think>"), -1), "```json|```", ""))
    listed = F.try_element_at(F.from_json(bare, "array<string>"), F.lit(1))
    first = lambda k: F.nullif(F.get_json_object(bare, k), F.lit(""))
    value = F.when(bare.startswith("{") & F.get_json_object(bare, "$").isNotNull(), F.coalesce(first("$.query"), first("$.search_query"), F.lit(""))).when(
        bare.startswith("[") & listed.isNotNull(), listed
    ).when(bare.rlike(r'(?s)^".*"$'), F.regexp_replace(bare, '^"|"$', "")).otherwise(bare)
    line = F.coalesce(F.try_element_at(F.filter(F.transform(F.split(value, r"[\r\n]+"), T.stripped), lambda x: x != ""), F.lit(-1)), F.lit(""))
    plain = F.regexp_replace(F.regexp_replace(line, r"^\s*(?:[-*]|\d+[.)、])\s*", ""), QUERY_LABELS, "")
    plain = T.stripped(F.regexp_replace(T.stripped(plain), "^[\"'`]+|[\"'`]+$", ""))
    return F.coalesce(T.search_query(text), F.substring(plain, 1, 256))


def objective_messages(instructions: str, query: Column, expected: Column) -> Column:
    """system, user and assistant messages of an objective question; null for other gold strings."""
    own = F.array(message("system", F.lit(instructions)), message("user", query), message("assistant", boxed_response(expected, False)))
    return F.when(T.gold_type(expected).isin("single", "multiple", "bool"), own)


def model_of_cache_dir(name: Column) -> Column:
    """models--org--name as org/name; else null."""
    return F.when(name.startswith("models--"), F.regexp_replace(F.substring(name, len("models--") + 1, 1 << 20), "--", "/"))
