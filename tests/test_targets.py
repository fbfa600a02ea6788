"""Targets, messages, cloze questions, the agent's step and workbooks on small inputs with expected values."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tesserae.functions import messages as M
from tesserae.operators import agent, cloze, targets
from tesserae.sources import sheets


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "quote", "want"),
    [
        ("氧化层厚度为 10nm。", "厚度为 10nm", "厚度为 10nm"), ("氧化层，厚度为 10 nm。", "氧化层厚度为10nm", "氧化层，厚度为 10 nm"), ("甲乙，甲乙", "甲、乙", None),
        ("abc", "a…c", None), ("abc", " ", None), (None, "a", None), ("Ｎ２气体", "n2气体", "Ｎ２气体"),
    ],
)
def test_aligned(text, quote, want):
    assert targets.aligned_text(text, quote) == want


def test_span_texts():
    clause = "the oxide layer is grown in dry oxygen"
    assert targets.span_texts(f"{clause}!\nheading without an end\nshort;{clause}") == [clause + "!", clause]
    assert targets.span_texts(f"x <!-- a; b --> {clause};") == [f"x <!-- a; b --> {clause};"]
    long = "ab cd" * 100 + "!"
    parts = targets.span_texts(long)
    assert len(parts) == 3 and all(p in long and len(p) <= 220 for p in parts)
    assert targets.span_texts(None) == targets.span_texts("") == targets.span_texts("cut off sentence here...") == []


def test_evidence_spans_number_first_occurrences(spark):
    a, b = "the oxide layer is grown in oxygen!", "the wafer is cleaned before etching!"
    rows = spark.createDataFrame([(1, "E02", "s", "", "reference", a + b), (1, "E01", "t", "", "noise", b), (2, "E01", "u", "", "reference", None)], "target_id long, evidence_id string, source string, heading string, quality_category string, text string")
    got = [(r.target_id, r.span_id, r.evidence_id, r.quote) for r in targets.evidence_spans(rows).orderBy("span_id").collect()]
    assert got == [(1, "S001", "E01", b), (1, "S002", "E02", a)]


def test_validated(spark):
    text = "Dry oxidation grows thin oxide layers slowly. Wet oxidation grows thick oxide layers quickly."
    good = [(1, "Dry oxidation grows thin oxide", "e1", "Dry oxidation grows thin oxide layers slowly"), (2, "Wet oxidation grows layers quickly", "E01", "Wet oxidation grows thick, oxide layers quickly")]
    cases = {
        1: ("answerable", good), 2: ("refused", good), 3: ("answerable", good[:1]), 4: ("answerable", [good[0], (2, "short", "E01", "Wet oxidation grows thick")]), 5: ("answerable", [good[0], (2, "x" * 9, "E07", "y")]),
        6: ("answerable", [good[0], (2, *good[0][1:])]), 7: ("answerable", [(1, "Dry oxidation makes oxide with HCl", "E01", good[0][3]), good[1]]), 8: ("answerable", [good[0], (2, good[1][1], "E02", good[1][3])]),
    }
    t = spark.createDataFrame([(k, "How is it made?", d) for k, (d, _) in cases.items()], "target_id long, question string, decision string")
    p = spark.createDataFrame([(k, *x) for k, (_, ps) in cases.items() for x in ps], "target_id long, index int, statement string, evidence_id string, quote string")
    e = spark.createDataFrame([(k, i, text, "s", "", q) for k in cases for i, q in (("E01", "reference"), ("E02", "noise"))], "target_id long, evidence_id string, text string, source string, heading string, quality_category string")
    got = {r.target_id: r for r in targets.validated(t, p, e).collect()}
    assert {k: r.reason for k, r in got.items()} == {
        1: "accepted", 2: "teacher_rejected", 3: "point_count", 4: "point_2:statement_length", 5: "point_2:unknown_evidence", 6: "near_duplicate_points", 7: "point_1:unsupported_statement_entities", 8: "point_2:untrusted_evidence",
    }
    assert [x.quote_alignment for x in got[1].points] == ["exact", "punctuation_repaired"] and got[1].points[1].quote == "Wet oxidation grows thick oxide layers quickly" and got[2].points is None


@pytest.mark.parametrize(
    ("payload", "n", "want"),
    [
        ('{"decision":"accept","complete":true,"point_checks":[{"index":2,"supported":true,"relevant":true},{"index":1,"supported":true,"relevant":true}]}', 2, True),
        ('{"decision":"accept","complete":true,"point_checks":[{"index":1,"supported":true,"relevant":true},{"index":1,"supported":true,"relevant":true}]}', 2, False),
        ('{"decision":"accept","complete":true,"point_checks":[{"index":1,"supported":true}]}', 1, False), ("no", 1, False), (None, 1, False),
    ],
)
def test_verifier(spark, payload, n, want):
    assert one(spark, targets.verifier_accepts(F.col("p"), F.lit(n)), p=payload) is want


def test_ids_and_queries(spark):
    df = spark.createDataFrame([("s7",), ("S1234",), ("x",)], "c string")
    assert [r[0] for r in df.select(targets.canonical_span(F.col("c"))).collect()] == ["S007", "S1234", "x"]
    assert one(spark, targets.query_candidates(F.col("q")), q="题目：说明干法刻蚀的作用，说明干法刻蚀的作用；短\n选项：A") == ["说明干法刻蚀的作用，说明干法刻蚀的作用；短", "干法刻蚀的作用"]
    assert one(spark, targets.query_candidates(F.col("q")), q=" ") == []


def test_leaks(spark):
    points = targets.leak_points(F.lit("[short] plasma etch/刻蚀|||wafer"))
    leak = targets.term_leak(F.col("q"), F.col("seen"), points)
    assert one(spark, leak, q="about wafer", seen="tools") and not one(spark, leak, q="about wafer", seen="a wafer")
    leak = targets.question_leak(F.col("q"), points)
    assert one(spark, leak, q="how does plasma work") and not one(spark, leak, q="how does it work")


def test_observations_show_what_fits(spark):
    rows = [(1, 1, "a", "h", 1.5, "x" * 20, "reference"), (1, 2, "b", "", 1.0, "y <search>", "noise")]
    df = spark.createDataFrame(rows, "query_id long, rank int, source string, heading string, raw_score double, snippet string, quality_category string")
    r = M.observations(df, 60).first()
    full = M.observations(df, 500).first()
    assert full.observation == "[检索结果]\n\n1. 来源：a · h\n相关度：1.50\n" + "x" * 20 + "\n\n2. 来源：b\n相关度：1.00\ny ＜search>"
    assert r.observation == full.observation[:60] and [v.snippet for v in r.visible] == ["x" * 20, ""] and full.visible[1].snippet == "y ＜search>"
    assert one(spark, M.visible_text(F.col("t")), t=full.observation) == "\n" + "x" * 20 + "\n\ny ＜search>"
    assert one(spark, M.rendered_sources(F.col("t")), t=full.observation) == ["a", "b"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("x <search> a  b </search>", "a b"), ("<think>no</think>\n```json\n{\"query\": \"q1\"}\n```", "q1"), ('["first", "second"]', "first"), ("one\n- 检索词：two", "two"), ('"quoted"', "quoted"), ("", ""),
        ("{\"search_query\": \"s\"}", "s"), ("1. query: 'abc'", "abc"),
    ],
)
def test_query_candidate(spark, text, want):
    assert one(spark, M.query_candidate(F.col("t")), t=text) == want


def test_responses_and_messages(spark):
    assert one(spark, M.boxed_response(F.col("e"), True), e="[fill] a/b|||c") == "依据检索证据，\\boxed{a; c}"
    assert one(spark, M.points_response(F.split("p", "#")), p="a# b") == "依据检索证据，答案要点为：1. a；2. b\n\\boxed{1. a；2. b}"
    assert one(spark, M.points_response(F.split("p", "#")), p="a#a") is None and one(spark, M.rebuilt_answer(F.split("p", "#")), p="a#b") == "[short] a ||| b"
    hops = F.array(F.struct(F.lit("q1").alias("query"), F.lit("o1").alias("observation")), F.struct(F.lit("q2").alias("query"), F.lit("o2").alias("observation")))
    got = one(spark, M.search_messages("s", F.lit("q"), F.lit("a"), hops), x="")
    assert [m.role for m in got] == ["system", "user", "assistant", "environment", "assistant", "environment", "assistant"] and "还可检索 1 次" in got[3].content and "用完" in got[5].content
    assert [m.content for m in one(spark, M.interleaved(F.split("r", "#"), F.split("o", "#")), r="a#b", o="x")] == ["a", "x", "b"]
    assert one(spark, M.last_text(F.split("r", "#")), r="a# b # ") == "b" and one(spark, M.until_search_close(F.col("r")), r="x</search> y") == "x</search>"
    assert one(spark, M.model_of_cache_dir(F.col("n")), n="models--org--name") == "org/name"


def test_cloze_answers_and_issues(spark):
    s = "刻蚀腔室的温度为 65 ℃，采用“等离子体”方法，由 RCP 控制。"
    assert [(a.kind, a.answer) for a in one(spark, cloze.answers(F.col("s")), s=s)] == [("numeric_unit", "65 ℃"), ("acronym", "RCP"), ("quoted_term", "等离子体")]
    issue = lambda s, a, k: one(spark, cloze.quality_issues(F.col("s"), F.col("a"), F.col("k")), s=s, a=a, k=k)
    assert issue(s, "RCP", "acronym") == []
    assert issue("- Slide number 3", "3", "numeric_unit") == ["boilerplate_or_slide_noise", "english_title_fragment", "insufficient_sentence_context", "missing_semantic_predicate", "missing_sentence_terminator", "slide_bullet_fragment"]
    assert issue("腔室的压力由控制器记录为 -RCP 并且保持稳定。", "RCP", "acronym") == ["hyphen_fragment"] and "malformed_leading_zero" in issue(s, "05 nm", "numeric_unit")


def test_cloze_masks_and_prompts(spark):
    assert one(spark, cloze.replaced_once(F.col("t"), F.col("p"), "_"), t="a RCP rcp", p="rcp") == "a _ rcp"
    assert one(spark, cloze.prompt(F.split("m", "#")), m="x【1】#y【1】").endswith("题目：\n1. x【1】\n2. y【2】")
    assert one(spark, cloze.model_query(F.col("h"), F.col("m"), F.col("a")), h="RCP setup", m="the 【1】 is", a="rcp") == "setup the 待填 is"


@pytest.mark.parametrize("n", [0, 1, 2, 7, 120, 260])
def test_pairs_like_the_ring(spark, n):
    rows = [(f"{i:04d}", "t", f"s{i % 3}", "【1】 is", f"name{i % 11}x", "") for i in range(n)]
    df = spark.createDataFrame(rows, "candidate_id string, split string, source string, masked_sentence string, answer string, model_query string")
    used, want = set(), []
    for i in range(n):
        for d in range(1, min(100, n)):
            j = (i + d) % n
            if i % 3 != j % 3 and i % 11 != j % 11 and frozenset((i, j)) not in used:
                used.add(frozenset((i, j)))
                want.append((f"{i:04d}", f"{j:04d}"))
                break
    assert sorted((r.first, r.second) for r in cloze.pairs(df).collect()) == sorted(want) if n != 1 else not cloze.pairs(df).collect()


def test_agent_step(spark):
    chunk = spark.createDataFrame([(0, "a", "", "etch rate is ten"), (1, "b", "", "etch rate of plasma"), (2, "答案", "", "etch words")], "chunk_id long, source string, heading string, text string")
    state = lambda i, response, **k: (i, "q", "[short] ten|||plasma", "", k.get("n", 0), k.get("bad", 0), k.get("least", 0), k.get("asked", []), k.get("seen", []), k.get("hits", []), response)
    rows = [
        state(1, "<search>etch rate</search>"), state(2, "<search>etch rate</search>", n=1, asked=["Etch rate"], seen=["a"], hits=[0]), state(3, "<search>x</search>", n=2), state(4, r"\boxed{ten plasma}"),
        state(5, r"\boxed{ten}", least=1), state(6, r"<search>a</search> \boxed{b}"), state(7, "none", bad=1), state(8, "none", n=2), state(9, "<search> </search>"),
    ]
    schema = "row_id long, query string, expected_answer string, bank string, search_count int, invalid_count int, minimum_searches int, search_queries array<string>, retrieved_sources array<string>, evidence_hits array<int>, response string"
    got = {r.row_id: r for r in agent.step(spark.createDataFrame(rows, schema), chunk, evidence_scale=1.0, search_cost=0.1, duplicate_penalty=0.2).collect()}
    assert {k: (r.action, r.terminated) for k, r in got.items()} == {
        1: ("search", False), 2: ("search", False), 3: ("beyond", True), 4: ("answer", True), 5: ("early", False), 6: ("invalid", False), 7: ("invalid", True), 8: ("invalid", True), 9: ("invalid", False),
    }
    assert got[1].reward == pytest.approx(0.9) and got[1].evidence_hits == [0, 1] and set(got[1].retrieved_sources) == {"a", "b", "答案"} and "还可检索 1 次" in got[1].observation
    assert got[2].reward == pytest.approx(0.5 - 0.1 - 0.2) and "a" not in M_sources(got[2].observation) and got[2].search_queries == ["Etch rate", "etch rate"]
    assert got[4].reward == 1.0 and got[3].reward == got[7].reward == got[8].reward == -0.5 and got[5].invalid_count == 0 and got[6].invalid_count == 1


def M_sources(text):
    return [line.split("来源：")[1] for line in text.split("\n") if "来源：" in line]


def workbook(sheet_rows: dict[str, list[list[str]]]) -> bytes:
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    out, texts = io.BytesIO(), []
    with zipfile.ZipFile(out, "w") as z:
        names = list(sheet_rows)
        z.writestr("xl/workbook.xml", f"<workbook {ns}><sheets>" + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(names))) + "</Relationships>")
        for i, n in enumerate(names):
            body = ""
            for at, row in enumerate(sheet_rows[n], 1):
                cells = ""
                for col, v in enumerate(row):
                    if v is not None:
                        texts.append(v)
                        cells += f'<c r="{chr(65 + col)}{at}" t="s"><v>{len(texts) - 1}</v></c>'
                body += f'<row r="{at}">{cells}</row>'
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{t}</t></si>" for t in texts) + "</sst>")
    return out.getvalue()


def test_workbooks(spark, tmp_path):
    choice = [["说明"], ["序号（必填）", "题目(必填)", "正确答案(必填)", "选项", None, "知识点", "难度*(必填)"], [None, None, None, "A", "B"], ["1", "q one", "a", "x", "y"], ["2", "q two", "L", "x", "y"], ["3", "q three", None, "x"], ["4", "这是单选题题目", "A", "x"]]
    judge = [["序号", "题目", "答案"], ["1", "is it", "不对"], ["2", "A. mixed", "对"], ["3", "is it", "?"]]
    fill = [["序号", "题目", "填空项"], [None, None, "空1", "空2"], ["1", "fill __", "a", "b"], ["2", "fill", None]]
    (tmp_path / "a.xlsx").write_bytes(workbook({"单选题": choice, "判断题": judge, "填空题": fill, "简答题": [["no header"]]}))
    (tmp_path / "b.xlsx").write_bytes(workbook({"other": [["x"]]}))
    (tmp_path / "c.xlsx").write_bytes(b"broken")
    rows = sheets.read_workbooks(spark, str(tmp_path))
    got = {(r.sheet, r.row_num): (r.issue, r.answer) for r in sheets.parsed(rows).collect()}
    assert got == {
        ("单选题", 4): (None, "A"), ("单选题", 5): ("answer_out_of_range", None), ("单选题", 6): ("missing_answer", None), ("判断题", 2): (None, "错"), ("判断题", 3): ("looks_like_mixed_choice", None),
        ("判断题", 4): ("missing_answer", None), ("填空题", 3): (None, "a|b"), ("填空题", 4): ("missing_answer", None), ("简答题", 0): ("missing_header", None),
    }
    assert {r.file: (r.status, r.questions) for r in sheets.statuses(rows).collect()} == {"a.xlsx": ("ok", 3), "b.xlsx": ("not_question_bank", 0), "c.xlsx": ("error", 0)}
    twice = sheets.parsed(rows)
    assert {r.copies for r in sheets.deduplicated(twice.unionByName(twice)).collect()} == {2}


def test_ends_lose_white_space_only(spark):
    from tesserae.functions import text as T
    from tesserae.sources.files import short_rows

    assert one(spark, T.canonical_answer(F.col("e")), e="[fill] 0.5\n|||11/x|||\t210 ") == "0.5; 11; 210"
    rows = spark.createDataFrame([("q", ["010", " 1a1 ", "\n"]), (" \n", ["x"]), ("q", [])], "query string, reference_keywords array<string>")
    assert [r.expected_answer for r in short_rows(rows).collect()] == ["[short] 010|||1a1"]


def test_pairs_keep_answers_out_of_prompts(spark):
    rows = [("a", "t", "s1", "【1】 is hot", "xenon", ""), ("b", "t", "s2", "xenon 【1】", "argon", ""), ("c", "t", "s3", "【1】 is cold", "helium", "about krypton"), ("d", "t", "s4", "【1】 flows", "krypton", "")]
    df = spark.createDataFrame(rows, "candidate_id string, split string, source string, masked_sentence string, answer string, model_query string")
    assert sorted((r.first, r.second) for r in cloze.pairs(df).collect()) == [("a", "c"), ("b", "c"), ("d", "a")]
