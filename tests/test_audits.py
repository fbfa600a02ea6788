"""Audits, attacks and scalable numbering on small inputs."""

import hashlib

from pyspark.sql import functions as F

from tesserae.operators import audits, sampling, scoring


def test_short_labels(spark):
    rows = [
        (1, "What does the plasma do?", "[short] etches oxide layers|||removes photoresist", "etch"), (2, "q", "[fill] ", ""), (3, "q", "[short] 设备", ""), (4, "what is dry etching", "[short] dry etching|||x||y", ""),
        (5, "q", "[short] anneal furnace one|||anneal furnace one!|||", "bank"), (6, "q", "[short] etch|||etching tools", "etch"), (7, None, None, None), (8, "q", "[short] " + "|||".join("abcdefg"), ""),
    ]
    got = {r.row_id: r for r in audits.short_labels(spark.createDataFrame(rows, "row_id long, query string, expected_answer string, bank string")).collect()}
    assert got[1].issue_codes == got[1].defect_reasons == got[1].defective == [] and got[1].keypoint_count == 2
    assert got[2].defect_reasons == ["not_short_answer", "empty_short_keypoints"] == got[7].defect_reasons and got[7].keypoint_count == 0
    assert got[3].defect_reasons == ["singleton_generic_keypoint", "singleton_very_short_keypoint", "singleton_topic_as_answer", "all_keypoints_are_topics"] and got[3].defective == [0]
    assert "malformed_keypoint_delimiter" in got[4].defect_reasons and "question_high_overlap:0" in got[4].issue_codes and "majority_keypoints_overlap_question" in got[4].defect_reasons
    assert {"empty_keypoint_segment", "near_duplicate_keypoints"} <= set(got[5].defect_reasons) and "empty_keypoint:2" in got[5].issue_codes
    assert "topic_as_answer:0" in got[6].issue_codes and "near_duplicate_keypoints" in got[6].defect_reasons and "too_many_keypoints" in got[8].defect_reasons


def test_protocol(spark):
    a, e = lambda t: ("assistant", t), lambda t: ("environment", t)
    rows = [
        (1, [("user", "q"), a("<search>x</search>"), e("o"), a(r"\boxed{A}")]), (2, [("user", "q")]), (3, [a("<search>x</search>"), a("<search>X.</search>"), a("<search> </search>"), a("none"), a(r"<search>z</search> \boxed{B}")]), (4, []),
    ]
    got = {r.row_id: r for r in audits.protocol(spark.createDataFrame(rows, "row_id long, messages array<struct<role:string,content:string>>")).collect()}
    assert got[1].issues == [] and got[1].search_queries == ["x"] and got[1].completion == r"\boxed{A}"
    assert got[2].issues == got[4].issues == ["missing_assistant_response", "missing_boxed_completion"]
    assert got[3].issues == ["empty_search_query", "invalid_assistant_action", "search_and_answer_in_same_turn", "too_many_searches", "duplicate_search_query"]


def test_hits_and_attribution(spark):
    hops = spark.createDataFrame([(1, 1, [0]), (1, 2, [0, 2]), (1, 3, []), (2, 1, [])], "row_id long, hop int, hits array<int>")
    got = {(r.row_id, r.hop): (r.new_hits, r.cumulative_hits) for r in audits.cumulative_hits(hops).collect()}
    assert got == {(1, 1): ([0], [0]), (1, 2): ([2], [0, 2]), (1, 3): ([], [0, 2]), (2, 1): ([], [])}
    rows = spark.createDataFrame([(1, True, ["x"], "full", 1.0, False), (2, False, ["x"], "none", 1.0, False), (3, False, [], "partial", 0.0, False), (4, False, [], "full", 1.0, True), (5, False, [], "full", 1.0, False)], "i int, d boolean, p array<string>, s string, r double, k boolean")
    args = [F.col(c) for c in "dpsrk"]
    got = [(r.a, r.l) for r in rows.select("i", audits.attribution(*args).alias("a"), audits.failure_labels(*args).alias("l")).orderBy("i").collect()]
    assert [a for a, _ in got] == ["label_defect", "protocol_failure", "partial_evidence", "synthesis_failure", "success"] and got[1][1] == ["protocol_failure", "unsupported_retrieval"]


def test_keyword_only_and_shown(spark):
    df = spark.createDataFrame([("[short] wafer|||etch", r"依据检索证据，\boxed{wafer; etch}", "wafer; etch"), ("[short] wafer", r"the wafer is cleaned with water \boxed{wafer}", "wafer")], "e string, c string, b string")
    assert [r[0] for r in df.select(audits.keyword_only(F.col("e"), F.col("c"), F.col("b"), F.lit(1.0))).collect()] == [True, False]
    shown = spark.createDataFrame([("[检索结果]\n\n1. 来源：wafer\n相关度：7.00\nplasma\n\n还可检索 1 次。etch",)], "o string")
    points = F.array(F.array(F.lit("wafer")), F.array(F.lit("plasma")), F.array(F.lit("etch")), F.array(F.lit("7")))
    assert shown.select(audits.shown_hits(F.col("o"), points)).first()[0] == [1]


def test_attacks(spark):
    rows = spark.createDataFrame([(1, "how", "[short] plasma/ab|||wafer"), (2, "how", "[short] wafer")], "row_id long, query string, expected_answer string")
    got = {(r.row_id, r.attack): (r.completion, r.reward) for r in scoring.attacks(rows).collect()}
    assert got == {
        (1, "keyword_stuffing"): (r"\boxed{plasma; wafer}", 1.0), (1, "shortest_keypoint"): (r"\boxed{ab}", 0.5), (1, "question_copy"): (r"\boxed{how}", 0.0),
        (2, "keyword_stuffing"): (r"\boxed{wafer}", 1.0), (2, "shortest_keypoint"): (r"\boxed{wafer}", 1.0), (2, "question_copy"): (r"\boxed{how}", 0.0), (2, "bare_singleton"): (r"\boxed{wafer}", 1.0),
    }


def test_numbering_of_a_hot_stratum(spark):
    rows = spark.range(3000).select(F.col("id").alias("k"), F.when(F.col("id") % 10 == 0, None).otherwise("hot").alias("s"))
    got = {r.k: r.position for r in sampling.hash_ranked(rows, ["s"], 7, "k").collect()}
    for null in (True, False):
        own = [k for k in range(3000) if (k % 10 == 0) == null]
        want = sorted(own, key=lambda k: (hashlib.sha256((f"7:{k}" if null else f"7:hot:{k}").encode()).hexdigest(), k))
        assert [got[k] for k in want] == list(range(1, len(own) + 1))
    assert sorted(r.draw for r in sampling.weighted_order(rows, F.lit(1.0), "k").collect()) == list(range(1, 3001))
    assert sampling.weighted_order(rows.where("false"), F.lit(1.0), "k").count() == 0
