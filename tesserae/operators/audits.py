"""Audits of short gold labels and of trajectories: label defects, protocol, hits by hop, what a failure is due to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import messages as M
from tesserae.functions import text as T
from tesserae.operators import curation, scoring
from tesserae.operators.curation import issues

# Terms that are no answer by themselves, and phrases that completions are padded with.
GENERIC_SHORT_TERMS = [
    "代码", "设备", "流程", "系统", "问题", "方法", "操作", "功能", "数据", "信息", "程序", "工艺", "原因", "结果",
    "内容", "步骤", "参数", "标准", "规范", "技术", "软件", "硬件", "模块", "平台", "工具", "产品", "材料", "文件",
    "文档", "测试", "方案", "code", "device", "equipment", "process", "system", "method", "operation", "procedure", "data", "program",
]
TEMPLATE_TERMS = ["依据检索证据", "根据检索证据", "依据证据", "根据证据", "最终答案", "答案是", "答案为", "分析后", "因此", "所以", "可知", "答案"]
POINT_ISSUES = ["generic_keypoint", "very_short_keypoint", "question_high_overlap", "topic_as_answer"]
GUIDANCE_MARKS = r"\n\n还可检索|\n\n检索次数已用完|\n\[检索反馈\]|\n\[检索约束\]"


def very_short(c: Column) -> Column:
    """Up to two characters with ideographs among them, or three letters and digits."""
    return F.when(c.rlike(r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]"), F.length(c) <= 2).otherwise(F.length(F.regexp_replace(F.lower(c), "[^a-z0-9]", "")) <= 3)


def label_points(rows: DataFrame) -> DataFrame:
    """row_id, index, alternatives (normalised), overlap, issues of each point of gold strings (row_id, query, expected_answer, bank)."""
    answer = T.stripped(T.gold_payload(F.col("expected_answer")))
    raw = rows.select("row_id", T.evidence_norm(F.coalesce("query", F.lit(""))).alias("asked"), T.evidence_norm(F.coalesce("bank", F.lit(""))).alias("bank"), answer.alias("answer"))
    points = raw.where("answer <> ''").select("row_id", "asked", "bank", F.posexplode(F.split("answer", r"\|\|\|")).alias("index", "raw"))
    parts = F.filter(F.transform(F.split("raw", "[/／]"), T.stripped), lambda x: x != "")
    alts = points.select("row_id", "index", "asked", "bank", F.posexplode_outer(parts).alias("at", "alt")).withColumn("norm", F.nullif(T.evidence_norm("alt"), F.lit("")))
    generic = F.col("norm").isin(*GENERIC_SHORT_TERMS)
    of_bank = (F.col("bank") != "") & (F.length("norm") >= 2) & ((F.col("norm") == F.col("bank")) | ((F.length("norm") <= 8) & F.contains("bank", F.col("norm"))))
    marked = alts.withColumns({"generic": generic, "brief": very_short(F.col("norm")), "topic": generic | of_bank, "overlap": curation.overlap_ratio("norm", "asked")})
    per = marked.groupBy("row_id", "index").agg(
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("norm").isNotNull(), F.struct("at", "norm")))), lambda x: x.norm)).alias("alternatives"),
        F.coalesce(F.max(F.when(F.col("norm").isNotNull(), F.col("overlap"))), F.lit(0.0)).alias("overlap"), *[F.coalesce(F.bool_and(c), F.lit(False)).alias(c) for c in ("generic", "brief", "topic")],
    )
    found = issues((F.size("alternatives") == 0, "empty_keypoint"), (F.col("generic"), POINT_ISSUES[0]), (F.col("brief"), POINT_ISSUES[1]), (F.col("overlap") >= 0.8, POINT_ISSUES[2]), (F.col("topic"), POINT_ISSUES[3]))
    return per.select("row_id", "index", "alternatives", "overlap", found.alias("issues"))


def short_labels(rows: DataFrame) -> DataFrame:
    """row_id, keypoint_count, issue_codes, defect_reasons, defective (indexes from 0) of gold strings; see label_points.

    Points are compared in pairs within one gold string only.
    """
    points = label_points(rows)
    alts = points.select("row_id", "index", F.explode("alternatives").alias("alt"))
    other = alts.select("row_id", F.col("index").alias("j"), F.col("alt").alias("other"))
    alike = alts.join(other, "row_id").where(F.col("index") < F.col("j")).where(curation.near_duplicate("alt", "other")).select("row_id").distinct().withColumn("alike", F.lit(True))
    per = points.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("index", "issues"))).alias("p")).join(alike, "row_id", "left")
    out = rows.select("row_id", "expected_answer").join(per, "row_id", "left")
    answer, n = T.stripped(T.gold_payload(F.col("expected_answer"))), F.coalesce(F.size("p"), F.lit(0))
    n, alike = F.when(F.col("p").isNull(), 0).otherwise(n), F.coalesce("alike", F.lit(False))
    p = F.coalesce("p", F.from_json(F.lit("[]"), per.schema["p"].dataType))
    having = lambda name: F.size(F.filter(p, lambda x: F.array_contains(x.issues, name)))
    marks = issues(
        (T.gold_type(F.col("expected_answer")) != "short", "not_short_answer"), (answer.rlike(r"(?<!\|)\|{1,2}(?!\|)|\|{4,}"), "malformed_keypoint_delimiter"),
        ((answer != "") & F.exists(F.split(answer, r"\|\|\|"), lambda x: T.stripped(x) == ""), "empty_keypoint_segment"),
    )
    by_point = F.flatten(F.transform(p, lambda x: F.transform(x.issues, lambda i: F.concat(i, F.lit(":"), x["index"].cast("string")))))
    codes = F.concat(marks, issues((n == 1, "singleton_keypoint"), (~n.between(2, 6), "target_point_count_out_of_range"), (alike, "near_duplicate_keypoints")), by_point)
    reasons = F.concat(marks, issues(
        (n == 0, "empty_short_keypoints"), (n > 6, "too_many_keypoints"), (alike, "near_duplicate_keypoints"), *[((n == 1) & (having(i) == 1), f"singleton_{i}") for i in POINT_ISSUES],
        ((n > 1) & (having("question_high_overlap") >= 0.5 * n), "majority_keypoints_overlap_question"), ((n > 0) & (having("topic_as_answer") == n), "all_keypoints_are_topics"),
    ))
    defective = F.transform(F.filter(p, lambda x: F.arrays_overlap(x.issues, F.array(*[F.lit(i) for i in POINT_ISSUES]))), lambda x: x["index"])
    return out.select("row_id", n.alias("keypoint_count"), F.array_distinct(codes).alias("issue_codes"), F.array_distinct(reasons).alias("defect_reasons"), defective.alias("defective"))


def protocol(rows: DataFrame) -> DataFrame:
    """row_id, search_queries, completion, issues of message arrays (row_id, messages)."""
    turns = rows.select("row_id", F.posexplode("messages").alias("pos", "m")).where("m.role = 'assistant'").select("row_id", "pos", F.coalesce("m.content", F.lit("")).alias("text"))
    turns = turns.withColumns({"asked": T.search_query(F.col("text")), "boxed": T.boxed("text").isNotNull()}).withColumn("norm", T.evidence_norm("asked"))
    asks = F.col("asked").isNotNull()
    turns = turns.withColumn("found", issues((F.col("asked") == "", "empty_search_query"), (asks & F.col("boxed"), "search_and_answer_in_same_turn"), (~asks & ~F.col("boxed"), "invalid_assistant_action")))
    per = turns.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("pos", "asked", "norm", "found"))).alias("t"), F.max_by("text", F.when(F.col("boxed"), F.col("pos"))).alias("completion"))
    real = F.filter("t", lambda x: F.coalesce(x.asked, F.lit("")) != "")
    norms = F.transform(real, lambda x: x.norm)
    late = issues(
        (F.col("t").isNull(), "missing_assistant_response"), (F.col("completion").isNull(), "missing_boxed_completion"), (F.size(real) > 2, "too_many_searches"),
        (F.size(F.array_distinct(norms)) < F.size(norms), "duplicate_search_query"),
    )
    empty = F.array().cast("array<string>")
    early = F.coalesce(F.flatten(F.transform("t", lambda x: x.found)), empty)
    return rows.select("row_id").join(per, "row_id", "left").select("row_id", F.coalesce(F.transform(real, lambda x: x.asked), empty).alias("search_queries"), "completion", F.array_distinct(F.concat(early, late)).alias("issues"))


def shown_hits(observation: Column, points: Column) -> Column:
    """Indexes of points that an observation shows, its ranks, scores and guidance left out."""
    return T.keypoint_hits(T.answer_free(F.element_at(F.split(M.visible_text(observation), GUIDANCE_MARKS), 1)), points)


def cumulative_hits(hops: DataFrame) -> DataFrame:
    """hops (row_id, hop, hits) with new_hits and cumulative_hits, in order of hop."""
    w = Window.partitionBy("row_id").orderBy("hop")
    union = lambda frame: F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits").over(frame))))
    before = union(w.rowsBetween(Window.unboundedPreceding, -1))
    return hops.withColumns({"new_hits": F.array_except("hits", before), "cumulative_hits": union(w.rowsBetween(Window.unboundedPreceding, 0))})


def keyword_only(expected: Column, completion: Column, boxed: Column, reward: Column) -> Column:
    """Is a fully rewarded completion nothing but its keywords and the usual phrases?"""
    phrases = F.array(*[T.answer_norm(F.lit(t)) for t in TEMPLATE_TERMS])
    words = F.flatten(F.transform(F.split(T.stripped(T.gold_payload(expected)), r"\|\|\|"), lambda k: scoring.alternatives(k)))
    longest = F.array_sort(words, lambda a, b: F.length(b) - F.length(a))
    left = F.aggregate(F.concat(phrases, longest, F.array(F.lit("boxed"))), T.answer_norm(completion), lambda s, t: F.replace(s, t, F.lit("")))
    return boxed.isNotNull() & (reward >= 1.0) & (F.length(left) < 8)


def failure_labels(defect: Column, protocol_issues: Column, support: Column, reward: Column, keywords: Column) -> Column:
    """All labels of a failure."""
    return issues(
        (defect, "label_defect"), (F.size(protocol_issues) > 0, "protocol_failure"), (support == "none", "unsupported_retrieval"), (support == "partial", "partial_evidence"),
        ((support == "full") & ((reward < 1.0) | keywords), "synthesis_failure"),
    )


def attribution(defect: Column, protocol_issues: Column, support: Column, reward: Column, keywords: Column) -> Column:
    """The first label, or success."""
    return F.coalesce(F.get(failure_labels(defect, protocol_issues, support, reward, keywords), 0), F.lit("success"))
