"""One step of a search agent over all its open conversations at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions import messages as M
from tesserae.functions import text as T
from tesserae.operators import retrieval, scoring

STATE = "row_id, query, expected_answer, bank, search_count, invalid_count, minimum_searches, search_queries, retrieved_sources, evidence_hits"
# What the agent is told.
BOTH, NEITHER, BLANK_QUERY = "同一轮不能同时检索并提交最终答案", "未检测到检索动作或最终 boxed 答案", "检索关键词为空"
FORMAT_HINT = "[格式提示] %s\n请只选择一个动作：<search>关键词</search>；或给出分析并以 \\boxed{...} 提交最终答案。"
FORMAT_ERROR = "[格式错误] %s\n%s，回合结束。检索须用 <search>关键词</search>，最终答案须用 \\boxed{...}。"
EXHAUSTED, REPEATED = "已无剩余检索回合", "连续格式错误"
TOO_EARLY = "[检索约束] 这道题必须先检索 %d 次再提交答案，当前已检索 %d 次，还需检索 %d 次。请输出 <search>新的关键词</search>。"
BEYOND = "[检索次数已用完] 最多允许 %d 次检索。本轮应提交 \\boxed{...}。"
SUBMITTED = "[最终答案已提交] reward=%.3f"
DUPLICATE = "\n[检索反馈] 本次关键词与之前重复，请避免无信息增量的检索。"
STILL_REQUIRED = "\n[检索约束] 提交答案前还需检索 %d 次，下一轮请更换关键词继续检索。"


def observed(chunk: DataFrame, queries: DataFrame, top_k: int = 4, most: int = 1800, per_result: int = 520) -> DataFrame:
    """query_id, observation: what a first search (query_id, query) shows, each result by its passage about the query."""
    found = retrieval.search(chunk, queries, top_k, fields=("heading", "text")).join(queries, "query_id")
    cut = found.select("query_id", "rank", "source", "heading", "raw_score", T.snippet(F.col("text"), F.col("query"), per_result).alias("snippet"))
    return M.observations(cut, most).select("query_id", "observation")


def step(turns: DataFrame, chunk: DataFrame, searches: int = 2, invalid: int = 2, top_k: int = 3, candidate_k: int | None = None, quality_rerank: bool = False, most: int = 1800, per_result: int = 520, evidence_scale: float = 0.0, search_cost: float = 0.0, duplicate_penalty: float = 0.0) -> DataFrame:
    """row_id, action, observation, reward, terminated and the next state of turns (the STATE columns and response).

    chunk has chunk_id, source, heading, text. Actions are answer, early (an answer before the searches it needs),
    search, beyond (a search after the last), invalid. An answer takes the rule's reward; invalid actions end a
    conversation at the `invalid`-th in a row or when no search is left. A later search leaves out sources seen.
    """
    if searches < 1 or invalid < 1 or min(evidence_scale, search_cost, duplicate_penalty) < 0:
        raise ValueError("searches and invalid must be positive, rewards not negative")
    asked = T.search_query(F.col("response"))
    t = turns.withColumn("_box", T.boxed("response")).withColumn("_asked", asked)
    box, n = F.col("_box").isNotNull(), F.col("search_count")
    why = F.when(box & F.col("_asked").isNotNull(), BOTH).when(~box & F.col("_asked").isNull(), NEITHER).when(~box & (F.col("_asked") == ""), BLANK_QUERY)
    action = F.when(F.col("_why").isNotNull(), "invalid").when(box & (n < F.col("minimum_searches")), "early").when(box, "answer").when(n >= searches, "beyond").otherwise("search")
    t = t.withColumn("_why", why).withColumn("action", action).withColumn("_points", T.keypoints(F.col("expected_answer")))

    searching = t.where("action = 'search'").withColumn("_query", T.retrieval_query(F.col("_asked"), F.col("query"), F.col("bank")))
    q = searching.select(F.col("row_id").alias("query_id"), F.col("_query").alias("query"))
    seen = searching.where("search_count > 0").select(F.col("row_id").alias("query_id"), F.explode("retrieved_sources").alias("source"))
    texts = retrieval.search(chunk, q, top_k, candidate_k, quality_rerank, excluded=seen, fields=("heading", "text")).join(q, "query_id")
    cut = texts.select("query_id", "rank", "source", "heading", "raw_score", T.snippet(F.col("text"), F.col("query"), per_result).alias("snippet"), "quality_category")
    t = t.join(M.observations(cut, most).withColumnRenamed("query_id", "row_id"), "row_id", "left")

    trusted = F.filter("visible", lambda v: v.quality_category.isin(*retrieval.TRUSTED))
    hits = F.flatten(F.transform(trusted, lambda v: T.keypoint_hits(T.answer_free(v.snippet), F.col("_points"))))
    old = F.filter("evidence_hits", lambda i: (i >= 0) & (i < F.size("_points")))
    search = F.col("action") == "search"
    none = F.array().cast("array<int>")
    t = t.withColumn("_old", old).withColumn("_new", F.when(search, F.array_sort(F.array_union("_old", F.coalesce(hits, none)))).otherwise(F.col("evidence_hits")))
    gain = F.coalesce((F.size("_new") - F.size("_old")) / F.nullif(F.size("_points"), F.lit(0)), F.lit(0.0))
    again = F.exists("search_queries", lambda s: T.answer_free(s) == T.answer_free(F.col("_asked")))
    t = t.withColumn("_again", search & again)
    ends = (F.col("invalid_count") + 1 >= invalid) | (n >= searches)
    scored = scoring.rule_reward(F.col("expected_answer"), F.col("response"), F.col("_box"))
    reward = (
        F.when(F.col("action") == "answer", scored).when((F.col("action") == "beyond") | ((F.col("action") == "invalid") & ends), scoring.NO_BOX)
        .when(search, evidence_scale * F.greatest(gain, F.lit(0.0)) - search_cost - F.when(F.col("_again"), duplicate_penalty).otherwise(0.0)).otherwise(0.0)
    )
    t = t.withColumn("reward", reward).withColumn("terminated", (F.col("action").isin("answer", "beyond")) | ((F.col("action") == "invalid") & ends))
    needed = F.col("minimum_searches") - n
    told = F.concat(
        F.coalesce("observation", F.lit(M.NO_RESULTS)), M.guidance(searches - n - 1),
        F.when(F.col("_again") & F.lit(duplicate_penalty > 0), DUPLICATE).otherwise(""), F.when(needed > 1, F.format_string(STILL_REQUIRED, needed - 1)).otherwise(""),
    )
    observation = (
        F.when(search, told).when(F.col("action") == "answer", F.format_string(SUBMITTED, F.col("reward"))).when(F.col("action") == "beyond", F.format_string(BEYOND, F.lit(searches)))
        .when(F.col("action") == "early", F.format_string(TOO_EARLY, F.col("minimum_searches"), n, needed))
        .when(F.col("terminated"), F.format_string(FORMAT_ERROR, F.col("_why"), F.when(n >= searches, EXHAUSTED).otherwise(REPEATED))).otherwise(F.format_string(FORMAT_HINT, F.col("_why")))
    )
    sources = F.array_union("retrieved_sources", F.coalesce(F.transform("visible", lambda v: v.source), F.array().cast("array<string>")))
    return t.select(
        "row_id", "action", observation.alias("observation"), "reward", "terminated", (n + search.cast("int")).alias("search_count"),
        F.when(search, 0).otherwise(F.col("invalid_count") + (F.col("action") == "invalid").cast("int")).alias("invalid_count"),
        F.when(search, F.concat("search_queries", F.array("_asked"))).otherwise(F.col("search_queries")).alias("search_queries"),
        F.when(search, sources).otherwise(F.col("retrieved_sources")).alias("retrieved_sources"), F.col("_new").alias("evidence_hits"),
        F.coalesce(F.size("_new") / F.nullif(F.size("_points"), F.lit(0)), F.lit(0.0)).alias("evidence_coverage"),
    )
