"""Operators on small inputs with expected values."""

import pytest
from pyspark.sql import functions as F

from tesserae.functions import text as T
from tesserae.operators import curation, evaluation, retrieval, sampling, scoring
from tesserae.streaming import telemetry


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Etch a.b-c rate", ["etch", "a.b-c", "rate"]), ("晶圆", ["晶", "圆", "晶圆", "晶圆"]), ("光刻胶", ["光", "刻", "胶", "光刻", "刻胶", "光刻胶"]),
        ("please x 题目", ["题", "目"]), ("", []), (None, []),
    ],
)
def test_tokens(spark, text, want):
    assert one(spark, T.tokens(F.col("t")), t=text) == want


@pytest.mark.parametrize(("text", "want"), [("no", None), ("<search> </search>", ""), ("<search>a  b</search> <search k=1>c\nd</search> e", "c d"), ("<search>open", "open")])
def test_search_query(spark, text, want):
    assert one(spark, T.search_query(F.col("t")), t=text) == want


def test_question_context(spark):
    assert one(spark, T.question_context(F.col("t")), t="请作答\n题目： 什么 是\n退火\n选项：\nA. x") == "什么 是 退火"


@pytest.mark.parametrize(("text", "want"), [(r"\boxed{A} \boxed{B}", "B"), (r"\boxed{a{b}c}", "a{b}c"), (r"\boxed{open", None), ("none", None)])
def test_boxed(text, want):
    assert T.boxed_text(text) == want


@pytest.mark.parametrize(
    ("expected", "completion", "want"),
    [
        ("[single] B", r"\boxed{b}", 1.0), ("[single] B", "B", -0.5), ("[bool] A", r"\boxed{B}", 0.0), ("[multiple] ABC", r"\boxed{AB}", 2 / 3), ("[multiple] AB", r"\boxed{ABC}", 0.75),
        ("[fill] 10|||wafer/硅", r"\boxed{10; 晶圆}", 1.0), ("[fill] a|||b", r"\boxed{b;a}", 0.0), ("[short] 退火|||掺杂", r"anneal first \boxed{doping}", 1.0), ("[other] x", r"\boxed{x}", 0.0), ("plain", r"\boxed{Plain.}", 1.0),
    ],
)
def test_rule_reward(spark, expected, completion, want):
    df = spark.createDataFrame([(expected, completion)], "expected_answer string, completion string")
    assert scoring.score(df).first()["reward"] == pytest.approx(want)


def test_quality_category(spark):
    c = retrieval.quality_category(F.col("s"), F.col("h"), F.col("t"))
    cases = [("a.md", "答案", "x", "answer-bearing"), ("试题.md", "", "x", "question-only"), ("试题.md", "", "答案：A", "answer-bearing"), ("a.md", "", "x", "reference"), ("a.md", "", "�" * 2 + "abc", "noise"), ("a.md", "", " ", "noise")]
    assert [one(spark, c, s=s, h=h, t=t) for s, h, t, _ in cases] == [x[-1] for x in cases]


def test_search_caps_and_excludes(spark):
    chunk = spark.createDataFrame([(i, "s1" if i < 4 else "s2", "", "etch rate " + "x1 " * i) for i in range(6)], "chunk_id long, source string, heading string, text string")
    q = spark.createDataFrame([(1, "etch rate")], "query_id long, query string")
    got = retrieval.search(chunk, q, top_k=4).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == [0, 1, 4, 5]
    gone = spark.createDataFrame([(1, "s1")], "query_id long, source string")
    assert {r.source for r in retrieval.search(chunk, q, excluded=gone).collect()} == {"s2"}


def test_split_text_overlaps_and_ends():
    text = "".join(f"sentence {i}。" for i in range(200))
    parts = retrieval.split_text(text, 300, 40)
    assert all(len(p) <= 300 for p in parts) and all(p.endswith("。") for p in parts) and text.startswith(parts[0]) and text.endswith(parts[-1])


def test_keypoints_and_hits(spark):
    df = spark.createDataFrame([("[fill] A 1/b|||c", "xa1 C")], "e string, t string")
    r = df.select(T.keypoints(F.col("e")).alias("k"), T.keypoint_hits(T.answer_free(F.col("t")), T.keypoints(F.col("e"))).alias("h")).first()
    assert r["k"] == [["a1", "b"], ["c"]] and r["h"] == [0, 1]


def test_duplicate_policy(spark):
    rows = spark.createDataFrame([(3, "a", "x"), (1, "a", "x"), (2, "b", "x"), (4, "b", "y"), (5, "", "x"), (6, "", "x")], "row_id long, question_key string, expected_key string")
    got = {r.row_id: (r.duplicate_group_size, r.duplicate_of, r.conflict) for r in curation.duplicate_policy(rows).collect()}
    assert got == {1: (2, None, False), 3: (2, 1, False), 2: (2, None, True), 4: (2, None, True), 5: (1, None, False), 6: (1, None, False)}


def test_message_issues(spark):
    good = [("system", "s"), ("user", "u"), ("assistant", "<search>q</search>"), ("environment", "[检索结果] r"), ("assistant", r"\boxed{A}")]
    bad = [("user", "u"), ("user", " "), ("assistant", "no"), ("assistant", "x")]
    df = spark.createDataFrame([(1, good), (2, bad), (3, good[:2]), (4, [])], "i int, m array<struct<role:string,content:string>>")
    got = {r.i: r.x for r in df.select("i", curation.message_issues(F.col("m")).alias("x")).collect()}
    assert got[1] == [] and got[3] == got[4] == ["too_few_messages"]
    assert {"missing_system", "invalid_content:1", "role_order:3", "invalid_search_action", "missing_boxed_answer"} <= set(got[2])


def test_split_is_disjoint_and_stable(spark):
    rows = spark.range(50).select(F.col("id").alias("k"), (F.col("id") % 3).alias("s"))
    a = {r.k: r.split for r in sampling.stratified_split(rows, ["s"], "k").collect()}
    assert a == {r.k: r.split for r in sampling.stratified_split(rows.repartition(7), ["s"], "k").collect()}
    assert len(a) == 50 and set(a.values()) == {"validation", "rl_holdout", "train"}


def test_curriculum_composition(spark):
    a, b = spark.range(5).toDF("k"), spark.range(100, 103).toDF("k")
    got = sampling.curriculum({"a": (a, 2), "b": (b, 1)}, 6, 1, "k").collect()
    assert len(got) == 18 and all(sum(r.step == s and r.pool == "a" for r in got) == 2 for s in range(1, 7))


def test_metrics_of_no_rows(spark):
    r = spark.createDataFrame([], "reward double").agg(*evaluation.metric_columns()).first()
    assert tuple(r) == (0, 0.0, 0.0, 0, 0.0)


def test_near_duplicate(spark):
    df = spark.createDataFrame([("abcd", "abcd"), ("abc", "xabcx"), ("ab", "abx"), ("abcdefgh", "abcdefgx"), (None, "a")], "a string, b string")
    assert [r[0] for r in df.select(curation.near_duplicate("a", "b")).collect()] == [True, True, False, False, False]


def test_sse_events():
    lines = ["id: 1", "event: log", "data: a", "data: b", "", ": beat", "data:c", ""]
    assert list(telemetry.sse_events(lines)) == [("1", "log", "a\nb"), ("1", "message", "c")]


def test_conversation_stream(spark, tmp_path):
    acts = [(1, 0, "search"), (1, 1, "answer"), (2, 0, "invalid"), (2, 1, "invalid"), (3, 0, "search"), (3, 1, "search"), (3, 2, "search")]
    schema = "conv_id long, turn long, action string"
    spark.createDataFrame(acts, schema).coalesce(1).write.json(str(tmp_path / "in"))
    stream = telemetry.conversation_state(spark.readStream.schema(schema).json(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("agent").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.conv_id, r.turn): (r.search_count, r.terminated, r.reward) for r in spark.table("agent").collect()}
    assert got[1, 1] == (1, True, 0.0) and got[2, 1] == (0, True, -0.5) and got[3, 2] == (2, True, -0.5)


def test_entry_imports_without_llm(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "retrieval_bm25_top4" in e.queries()
