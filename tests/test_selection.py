"""Selection, stored indexes, curricula with a bonus slot, and faults that an earlier version had."""

import json
import math
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesserae.functions import text as T
from tesserae.operators import cloze, curation, evaluation, retrieval, sampling, scoring, selection, targets
from tesserae.plans.index import Index
from tesserae.streaming import telemetry


def naive_bm25(chunks, query, k1=1.5, b=0.75):
    token = lambda t: [w for w in re.findall(r"[a-z0-9]+(?:[._+#/-][a-z0-9]+)*", t.lower()) if len(w) > 1 and w not in T.STOP_TERMS]
    bags = {i: Counter(token("\n".join([s, s, h, h, t]))) for i, s, h, t in chunks}
    df, mean = Counter(w for bag in bags.values() for w in bag), sum(sum(x.values()) for x in bags.values()) / len(bags)
    out = {}
    for i, bag in bags.items():
        score = 0.0
        for w, qf in Counter(token(query)).items():
            if tf := bag.get(w):
                score += math.log(1 + (len(bags) - df[w] + 0.5) / (df[w] + 0.5)) * (1 + math.log(qf)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * sum(bag.values()) / mean))
        if score:
            out[i] = round(score, 6)
    return out


@pytest.mark.parametrize("rare", [1, 32])
def test_pruned_search_is_that_of_all_scores(spark, tmp_path, rare, monkeypatch):
    monkeypatch.setattr(retrieval, "RARE", rare)
    r = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    draw = lambda n: " ".join(r.choices(words, [1 / (i + 1) for i in range(60)], k=n))
    chunks = [(i, f"s{r.randrange(40)}", draw(2), draw(r.randrange(0, 40))) for i in range(300)] + [(900, "s1", "", "")]
    queries = [(i, draw(r.randrange(1, 12))) for i in range(25)] + [(50, "absent terms"), (51, ""), (52, None)]
    chunk, asked = spark.createDataFrame(chunks, "chunk_id long, source string, heading string, text string"), spark.createDataFrame(queries, "query_id long, query string")
    index = Index.build(chunk, str(tmp_path / "index"))
    want, source = [], {c[0]: c[1] for c in chunks}
    for q, text in queries:
        seen, rank = Counter(), 0
        for i, s in sorted(naive_bm25(chunks, text or "").items(), key=lambda x: (-x[1], x[0])):
            seen[source[i]] += 1
            if seen[source[i]] <= 2 and rank < 6:
                rank += 1
                want.append((q, rank, i, s))
    for at in (chunk, Index.load(spark, str(tmp_path / "index"))):
        assert sorted(map(tuple, retrieval.search(at, asked, top_k=6).select("query_id", "rank", "chunk_id", "score").collect())) == want
    assert retrieval.chunks_of(index, ["noise"]).count() == sum(not c[3] for c in chunks) and retrieval.chunks_of(index).count() == 301


def test_split_text():
    def naive(text, size, overlap):
        out, start = [], 0
        while start < len(text):
            end = start + size
            if end < len(text):
                end = max([i + 1 for i in range(start + size // 2, end) if text[i] in "\n。；;"], default=end)
            out.append(text[start:end].strip())
            if end >= len(text):
                break
            start = max(start + 1, end - overlap)
        return [x for x in out if x]

    r = random.Random(1)
    for _ in range(300):
        text = "".join(r.choice("ab \n。;") if r.random() < 0.2 else "x" for _ in range(r.randrange(0, 900)))
        for size, overlap in ((200, 0), (200, 40), (260, 199)):
            assert retrieval.split_text(text, size, overlap) == naive(text, size, overlap)


def test_candidates_by_what_is_shown(spark):
    filler = "common words about the wafer line and its tools. "
    chunks = [(1, "a", "", "alpha topic tells that beta9 and gamma7 matter. " + filler), (2, "b", "", "delta topic here. " + filler * 8), (3, "c", "", "epsilon topic tells zeta5. " + filler), (4, "d quiz", "", "eta topic theta3. " + filler)]
    rows = [(1, "alpha topic", "[short] beta9|||gamma7"), (2, "epsilon topic", "[fill] zeta5|||nowhere8"), (3, "eta topic", "[short] theta3"), (4, "unseen", "[short] none1"), (5, "alpha", "[single] A")]
    df = spark.createDataFrame([(i, q, e, "", "full") for i, q, e in rows], "row_id long, query string, expected_answer string, bank string, declared_support string")
    got = {r.row_id: r for r in selection.candidates(spark.createDataFrame(chunks, "chunk_id long, source string, heading string, text string"), df).collect()}
    assert {i: (r.selection_status, r.dataset_role, r.recommended_search_turns) for i, r in got.items()} == {1: ("ready_one_search", "primary", 1), 2: ("partial_review", "secondary", None), 3: ("ready_one_search", "primary", 1), 4: ("excluded_unsupported", "excluded", None)}
    assert got[1].results[0].source == "a" and got[1].results[0].keypoint_hits == [0, 1] and got[4].results is None and got[3].pool_coverage == 0.0 and got[2].support_mismatch


def test_evidence_records(spark):
    rows = [(1, "wafer", 1, "s", "h", "reference", "wafer text that is long enough here"), (1, "wafer", 2, "s", "h", "reference", "the same place again, long enough"), (1, "wafer", 3, "t", "", "noise", "x" * 50), (1, "wafer", 4, "u", "", "reference", "short"), (1, "wafer", 5, "v", "", "answer-bearing", "y" * 24)]
    df = spark.createDataFrame(rows, "query_id long, query string, rank int, source string, heading string, quality_category string, text string").withColumns({"score": F.lit(1.0), "raw_score": F.lit(1.0)})
    assert sorted((r.evidence_id, r.source) for r in selection.evidence_records(df).collect()) == [("E01", "s"), ("E02", "v")]


def test_verdicts(spark):
    good = {"decision": "accept", "confidence": 1, "complete_natural_statement": True, "meaningful_answer": True, "noise": dict.fromkeys(selection.NOISE_FIELDS, False), "reason": "fine"}
    cases = [({}, None), ({"confidence": True}, "schema_confidence"), ({"confidence": "0.5"}, "schema_confidence"), ({"confidence": 1.5}, "schema_confidence"), ({"decision": None}, "schema_decision"), ({"noise": {}}, "schema_noise_fields"), ({"noise": None}, "schema_noise_fields"), ({"noise": good["noise"] | {"other_noise": 0}}, "schema_noise_type"), ({"noise": good["noise"] | {"other_noise": True}}, "schema_contradiction"), ({"reason": "x" * 241}, "schema_reason"), ({"reason": 5}, "schema_reason"), ({"meaningful_answer": "true"}, "schema_meaningful_answer"), ({"decision": "reject"}, "schema_contradiction")]
    rows = [(n, json.dumps(good | c)) for n, (c, _) in enumerate(cases)] + [(100, "x"), (101, None), (102, "[1]"), (103, "{}"), (104, "5")]
    got = {r.n: r.i for r in spark.createDataFrame(rows, "n int, t string").select("n", selection.verdict_issue(F.col("t")).alias("i")).collect()}
    assert got == {n: want for n, (_, want) in enumerate(cases)} | {100: "invalid_json", 101: "invalid_json", 102: "schema_not_object", 103: "schema_fields", 104: "schema_not_object"}


def test_flat_maps(spark):
    rows = [(1, '{"a": {"b": 1, "c": [1, {"d": null}]}, "e": "x"}'), (2, "[1]"), (3, "{broken"), (4, None), (5, "{}")]
    df = spark.createDataFrame(rows, "n int, t string")
    assert {r.n: r.f for r in df.select("n", selection.flattened(F.col("t")).alias("f")).collect()} == {1: {"a.b": "1", "a.c": '[1, {"d": null}]', "e": "x"}, 2: None, 3: None, 4: None, 5: {}}
    assert df.where("n = 1").select(selection.flattened(F.col("t"), True).alias("f")).first().f == {"a.b": "1", "a.c[0]": "1", "a.c[1].d": "null", "e": "x"}
    nested = spark.sql("select struct(1 as x, struct('q' as z) as y) as s, 2 as t")
    assert nested.select(selection.flat_columns(nested.schema)).first().asDict() == {"s.x": 1, "s.y.z": "q", "t": 2}


@pytest.mark.parametrize("two", [0, 1, 7])
def test_short_curriculum(spark, two):
    holdout = spark.createDataFrame([(i, "fill" if i % 2 else "short", 2 if i < two else 1) for i in range(11)], "row_id long, kind string, search_turns int")
    objective = spark.createDataFrame([(100 + i,) for i in range(3)], "row_id long")
    rows = sampling.short_curriculum(holdout, objective, 12).collect()
    by = defaultdict(dict)
    for r in rows:
        by[r.step][r.slot if r.slot in ("objective", "fill", "short") else "bonus"] = r
    assert len(rows) == 48 and set(by) == set(range(1, 13))
    for step, r in by.items():
        assert set(r) == {"objective", "fill", "short", "bonus"} and len({x.row_id for x in r.values()}) == 4
        assert r["fill"].row_id % 2 and not r["short"].row_id % 2 and r["objective"].minimum_searches == 0
        assert (r["bonus"].slot == "two_search") == (r["bonus"].row_id < two) and (two < 7 or step % 2 == 0 or r["bonus"].slot == "two_search")
    assert Counter(r["objective"].row_id for r in by.values()) == {100: 4, 101: 4, 102: 4}
    with pytest.raises(ValueError, match="overlap"):
        sampling.short_curriculum(holdout, holdout.select("row_id"), 2)
    with pytest.raises(ValueError, match="not enough"):
        sampling.balanced_curriculum(objective, objective, objective, 2, 16, 1, "row_id")
    assert sampling.balanced_curriculum(objective, objective, objective, 5, 4, 1, "row_id").groupBy("step").count().where("count <> 4").count() == 0


def test_rows_that_stopped_a_job(spark):
    df = spark.createDataFrame([("q", "o", []), ("ab", "o", [["ab"]])], "q string, o string, p array<array<string>>")
    assert [r.x for r in df.select(curation.leaked_points(F.col("q"), F.col("o"), F.col("p")).alias("x")).collect()] == [[], [0]]
    target = spark.createDataFrame([(1, "what is it", "answerable")], "target_id long, question string, decision string")
    quote = "the wafer holder keeps the temperature of chamber seven"
    points = spark.createDataFrame([(1, 1, quote, "E01", quote), (1, 1, quote, "E01", quote)], "target_id long, index int, statement string, evidence_id string, quote string")
    evidence = spark.createDataFrame([(1, "E01", quote + ".", "s", "", "reference")], "target_id long, evidence_id string, text string, source string, heading string, quality_category string")
    assert targets.validated(target, points, evidence).count() == 1
    summaries = spark.createDataFrame([("a", 0.5, 1, 1), ("b", 0.6, 2, 1)], "run string, accuracy double, perfect_count long, step int")
    assert evaluation.gate(summaries, "a").collect()[0].passed
    for bad in (summaries.unionByName(summaries), summaries.where("run = 'b'")):
        with pytest.raises(Exception, match="baseline a"):
            evaluation.gate(bad, "a").collect()


def test_unicode_classes(spark):
    df = spark.createDataFrame([("半导体quiz",), ("a quiz",)], "s string")
    assert [r.c for r in df.select(retrieval.quality_category(F.col("s"), F.lit(""), F.lit("text")).alias("c")).collect()] == ["reference", "question-only"]


def test_cloze_sentences(spark):
    good = "晶圆传送机构的真空吸附压力范围为50 mV，用于检测传送过程中的异常情况并记录结果。"
    rows = [(1, "a", "", good), (2, "b", "", "压力为50 mV。"), (3, "c", "", good.replace("异常", "答案")), (4, "d", "", good.replace("异常", "____")), (5, "e", "", good + "\n答案：50 mV"), (6, "f", "", good[:-1].replace("。", "") + "长" * 200 + "。")]
    got = cloze.candidates(spark.createDataFrame(rows, "chunk_id long, source string, heading string, text string")).collect()
    assert [(r.source, r.answer) for r in got] == [("a", "50 mV")]


def test_synonyms(spark):
    df = spark.createDataFrame([("wafer/退火",), ("x",), ("/",)], "b string")
    assert [sorted(r.a) for r in df.select(scoring.alternatives(F.col("b")).alias("a")).collect()] == [sorted(["wafer退火", "wafer", "退火", "晶圆", "硅片", "anneal", "annealing"]), ["x"], []]


def test_ordered(spark):
    texts = [f"{c}{i}" for c in "abé日" for i in range(40)]
    df = spark.createDataFrame([(t, len(t)) for t in texts], "k string, n int").repartition(3)
    assert [r.k for r in sampling.ordered(df, [], "k", "p").orderBy("p").collect()] == sorted(texts)
    assert sorted((r.exposure, r.k) for r in sampling.cycled(df.select("k"), 200, "k").collect()) == [(i, sorted(texts)[i % 160]) for i in range(200)]


def test_server_events(spark):
    lines = ["id: 7", "event: log", "data: a", "data:b", "", ": comment", "data: c", "", "event: x", "", "id: 8", "data: d"]
    want = [("7", "log", "a\nb"), ("7", "message", "c"), ("8", "message", "d")]
    assert list(telemetry.sse_events(lines)) == want
    body = spark.createDataFrame([(1, "\r\n".join(lines)), (2, ""), (3, None)], "stream long, body string")
    assert [(r.id, r.event, r.data) for r in telemetry.server_events(body).orderBy("stream", "pos").collect()] == want


def test_log_text_keeps_line_ends(spark):
    now = F.to_timestamp(F.lit("2024-01-02 03:04:05"))
    df = spark.createDataFrame([("a\n\nb\r\nc",), ("",)], "t string")
    assert [r.t for r in df.select(T.clean_log_text(F.col("t"), now).alias("t")).collect()] == ["2024-01-02 03:04:05 a\n\n2024-01-02 03:04:05 b\r\n2024-01-02 03:04:05 c", ""]


def test_terms_of_a_batch_are_those_of_the_expression(spark, monkeypatch):
    monkeypatch.setattr(T, "STEP", 400)
    r = random.Random(3)
    letters = ["a", "b", "Z", "9", "é", "K", "İ", "晶", "圆", "所有", "あ", " ", "\n", "-", "/", ".", "#", "answer", "please", " "]
    texts = ["".join(r.choices(letters, k=r.randrange(30))) for _ in range(400)] + ["", None, "-", "a-", "-a", "a", "question", "a.b"]
    want = [Counter(x.t) for x in spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", T.tokens(F.col("s")).alias("t")).orderBy("i").collect()]
    got = [Counter() for _ in texts]
    for at, _, words, row in T.terms_of(pa.array(["x", *texts]).slice(1)):
        for word, i in zip(words.to_pylist(), row.tolist(), strict=True):
            got[at + i][word] += 1
    assert got == want


def test_a_table_of_chunks_is_searched_without_a_shuffle_of_terms_or_texts(spark, tmp_path, monkeypatch):
    """Copies that tie, sources left out, several slices of queries and blocks of chunks: as by the stored index."""
    monkeypatch.setattr(retrieval, "SLICE", 3)
    monkeypatch.setattr(retrieval, "CELLS", 20)
    r = random.Random(8)
    draw = lambda n: " ".join(r.choices([f"w{i}" for i in range(15)], k=n))
    texts = [draw(r.randrange(1, 9)) for _ in range(30)]
    rows = [(i, f"s{i % 7}" if i % 11 else None, "", texts[i % 30]) for i in range(150)]
    chunk = spark.createDataFrame(rows, "chunk_id long, source string, heading string, text string").repartition(5)
    asked = spark.createDataFrame([(f"q{i}", draw(4)) for i in range(8)], "query_id string, query string")
    gone = spark.createDataFrame([("q1", "s3"), ("q1", "s4"), ("q5", "s0"), ("q9", "s1")], "query_id string, source string")
    index = Index.build(chunk, str(tmp_path / "index"))
    found = retrieval.search(chunk, asked, top_k=5, excluded=gone, fields=("text",))
    columns = ["query_id", "rank", "chunk_id", "source", "score", "text"]
    got = sorted(map(tuple, found.select(columns).collect()), key=str)
    assert got == sorted(map(tuple, retrieval.search(index, asked, top_k=5, excluded=gone, fields=("text",)).select(columns).collect()), key=str) and len(got) == 40
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "Generate" not in plan and "strategy=broadcast" in plan


def test_postings_are_counted_in_their_rows(spark):
    rows = [(1, "S1", "", "b a b"), (2, "S1", None, "晶圆 b b-c"), (3, None, "", None), (4, "", "", "answer x1 x1")]
    chunk = spark.createDataFrame(rows, "chunk_id long, source string, heading string, text string").repartition(2)
    by_row = chunk.select("chunk_id", F.explode(T.tokens(F.concat_ws("\n", "source", "source", "heading", "heading", "text"))).alias("term"))
    want = Counter((x.chunk_id, x.term) for x in by_row.collect())
    made = retrieval.postings(chunk)
    got = made.collect()
    assert {(x.chunk_id, x.term): x.tf for x in got} == dict(want) and len(got) == len(want)
    assert {x.chunk_id: x.len for x in got} == {i: sum(n for (j, _), n in want.items() if j == i) for i in (1, 2, 4)}
    terms = {t for _, t in want}
    assert {(x.term, x.df, x.cf) for x in retrieval.term_counts(chunk).collect()} == {(t, sum(u == t for _, u in want), sum(n for (_, u), n in want.items() if u == t)) for t in terms}
    assert "hashpartitioning" not in made._jdf.queryExecution().executedPlan().toString()


def test_distinct_texts_make_a_key_once_a_value(spark):
    values = F.array(*[F.concat(F.col("id").cast("string"), F.lit(x)) for x in (" a", ", A ", "", "b", "B.")])
    plan = spark.range(3).select(selection.distinct_texts(values).alias("t"))
    assert plan.where("id = 2").first().t == ["2 a", "2", "2b"]
    assert spark.sql("select array('x', null, ' ', 'X.') v").select(selection.distinct_texts(F.col("v")).alias("t")).first().t == ["x"]
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 1


def test_a_verdict_is_parsed_once(spark):
    rows = spark.createDataFrame([('{"decision": "accept"}',), ("[1]",), ("{",), (None,)], "t string")
    made = rows.select(selection.verdict_issue(F.col("t")).alias("i"))
    assert [r.i for r in made.collect()] == ["schema_fields", "schema_not_object", "invalid_json", "invalid_json"]
    assert made._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson") <= 2


def test_cloze_answers_are_looked_for_in_one_copy_of_a_sentence(spark):
    text = "The blue ring part of our line is used for a thickness of 3 mm."
    rows = [(i, f"s{i % 5}", "", text) for i in range(50)] + [(99, "s9", "", "See 5 mm there and 6 mm as well in a line of some words.")]
    made = cloze.candidates(spark.createDataFrame(rows, "chunk_id long, source string, heading string, text string"))
    assert [(r.source, r.sentence, r.answer) for r in made.collect()] == [("s0", text, "3 mm")]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    aggregate = plan.index("Aggregate")
    assert "numeric_unit" in plan[:aggregate] and "numeric_unit" not in plan[aggregate:]
