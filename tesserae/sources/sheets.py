"""Question banks in spreadsheets: workbooks as rows of cells, and rows of cells as questions.

A workbook is one file of one task (it can't be split); all that follows is expressions over its rows.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import text as T

# Sheet names by kind, example texts, header words, names of XML parts.
CHOICE, JUDGE, FILL, SHORT = ["单选题", "多选题"], "判断题", "填空题", "简答题"
SHEETS = [*CHOICE, JUDGE, FILL, SHORT]
EXAMPLES = ["示例导入前请删除", "（示例", "(示例", "这是单选题题目", "这是一道多选题", "这是一道判断题", "这是一道填空题", "这是一道简答题"]
EASY = "简单"
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
CELLS = "file string, sheet string, row_num int, cells array<string>, error string"


def _column(reference: str) -> int:
    n = 0
    for letter in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(letter) - 64
    return n - 1


def _value(cell, shared: list[str]) -> str | None:
    kind, v = cell.get("t"), cell.find(f"{MAIN}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
    if v is None or v.text is None:
        return None
    return shared[int(v.text)] if kind == "s" else {"1": "True", "0": "False"}[v.text] if kind == "b" else v.text


def workbook_rows(content: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row number from 1, cells) of a workbook, rows and cells without a value left out or null."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")]
        parts = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{MAIN}sheet"):
            part, at = parts[sheet.get(RELATION)], 0
            rows = ElementTree.fromstring(z.read(part.lstrip("/") if part.startswith("/") else f"xl/{part}"))
            for row in rows.iter(f"{MAIN}row"):
                at, cells = int(row.get("r") or at + 1), []
                for i, cell in enumerate(row.iter(f"{MAIN}c")):
                    place = _column(cell.get("r")) if cell.get("r") else i
                    cells += [None] * (place - len(cells)) + [_value(cell, shared)]
                yield sheet.get("name"), at, cells
            if not at:
                yield sheet.get("name"), 0, []


def read_workbooks(spark: SparkSession, root: str) -> DataFrame:
    """file, sheet, row_num, cells, error of all .xlsx files below root; a file that can't be read is one row with its error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                name = path.rsplit("/", 1)[-1]
                try:
                    out += [(name, *r, None) for r in workbook_rows(bytes(content))]
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, IndexError) as e:
                    out.append((name, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["file", "sheet", "row_num", "cells", "error"]).astype({"row_num": "Int32"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xlsx").load(root)
    return files.select("path", "content").mapInPandas(run, CELLS)


def header_text(c: Column) -> Column:
    return F.regexp_replace(T.stripped(F.coalesce(c, F.lit(""))), r"（必填）|\(必填\)|\*| ", "")


def column_index(headers: Column, *names: str) -> Column:
    """Place from 0 of the first header that holds, or is held by, the first name that any does; else null."""
    at = lambda n: F.nullif(F.array_position(F.transform(headers, lambda h: (h != "") & (F.contains(h, F.lit(n)) | F.contains(F.lit(n), h))), F.lit(True)), F.lit(0))
    return (F.coalesce(*[at(n) for n in names]) - 1).cast("int")


def knowledge_points(c: Column) -> Column:
    return F.array_join(F.slice(F.filter(F.transform(F.split(c, "[|｜]"), T.clean_cell), lambda x: x != ""), 1, 5), "|")


def parsed(rows: DataFrame) -> DataFrame:
    """file, sheet, row_num, issue and, where that is null, qtype, question, answer, options, knowledge_points,
    difficulty, explanation of the rows of question sheets (read_workbooks); issues of a whole sheet have row 0."""
    rows = rows.where(F.col("sheet").isin(*SHEETS))
    first = F.transform(F.slice("cells", 1, 8), header_text)
    is_header = F.array_contains(first, "序号") & F.arrays_overlap(first, F.array(F.lit("题目"), F.lit("试题")))
    heads = rows.groupBy("file", "sheet").agg(F.min(F.when(is_header, F.struct("row_num", "cells"))).alias("h"))
    heads = heads.withColumn("headers", F.transform("h.cells", header_text))
    found = lambda *names: column_index(F.col("headers"), *names)
    choice = F.col("sheet").isin(*CHOICE)
    heads = heads.withColumns({
        "q": found("题目"), "a": found("正确答案", "答案"), "kp": found("知识点"), "diff": found("难度"), "exp": found("答案解析", "解析"),
        "start": F.when(choice, F.coalesce(found("选项"), F.lit(3))).when(F.col("sheet") == FILL, F.coalesce(found("填空项"), F.lit(2))).when(F.col("sheet") == SHORT, F.coalesce(found("关键词"), F.lit(2))),
    })
    needs_answer = choice | (F.col("sheet") == JUDGE)
    heads = heads.withColumn("bad", F.when(F.col("h").isNull(), "missing_header").when(F.col("q").isNull() | (needs_answer & F.col("a").isNull()), "bad_header"))
    of_sheet = heads.where("bad is not null").select("file", "sheet", F.lit(0).alias("row_num"), F.col("bad").alias("issue"))

    cell = lambda i: T.clean_cell(F.coalesce(F.get("cells", i), F.lit("")))
    optional = lambda c: F.when(F.col(c).isNotNull(), cell(F.col(c))).otherwise("")
    body = rows.join(heads.where("bad is null").drop("headers", "bad"), ["file", "sheet"])
    body = body.where(F.col("row_num") >= F.col("h.row_num") + F.when(F.col("sheet") == JUDGE, 1).otherwise(2)).withColumn("question", cell(F.col("q")))
    example = F.exists(F.array(*[F.lit(e) for e in EXAMPLES]), lambda e: F.contains(F.col("question"), e))
    body = body.where((F.col("question") != "") & ~example)
    width = F.when(choice, 12).otherwise(10)
    own = F.when(F.col("sheet") == JUDGE, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), width - 1), lambda i: T.clean_cell(F.coalesce(F.get(F.col("cells"), F.col("start") + i), F.lit("")))))
    body = body.withColumn("options", own)
    raw = F.when(needs_answer, cell(F.col("a")))
    answer = (
        F.when(F.col("sheet") == CHOICE[0], T.choice_answer(raw, True)).when(F.col("sheet") == CHOICE[1], T.choice_answer(raw, False))
        .when(F.col("sheet") == JUDGE, T.judge_answer(raw)).otherwise(F.nullif(F.array_join(F.filter("options", lambda o: o != ""), "|"), F.lit("")))
    )
    letters = F.filter(F.transform("options", lambda o, i: F.when(o != "", F.char(i + 65)).otherwise("")), lambda x: x != "")
    outside = choice & (F.size(letters) > 0) & (F.size(F.array_except(F.split("answer", ""), letters)) > 0)
    issue = (
        F.when((F.col("sheet") == JUDGE) & F.col("question").rlike(r"[A-L][.、．)]"), "looks_like_mixed_choice").when(F.col("answer").isNull() & (F.col("sheet") == SHORT), "missing_keywords")
        .when(F.col("answer").isNull(), "missing_answer").when(outside, "answer_out_of_range")
    )
    body = body.withColumn("answer", answer).withColumn("issue", issue)
    kept = lambda c: F.when(F.col("issue").isNull(), c)
    explained = F.when(needs_answer, optional("exp")).otherwise("")
    of_rows = body.select(
        "file", "sheet", "row_num", "issue", kept(F.col("sheet")).alias("qtype"), kept(F.col("question")).alias("question"), kept(F.col("answer")).alias("answer"), kept(F.col("options")).alias("options"),
        kept(knowledge_points(optional("kp"))).alias("knowledge_points"), kept(F.coalesce(F.nullif(optional("diff"), F.lit("")), F.lit(EASY))).alias("difficulty"), kept(explained).alias("explanation"),
    )
    return of_rows.unionByName(of_sheet, allowMissingColumns=True)


def statuses(rows: DataFrame) -> DataFrame:
    """file, status, questions, issues of all workbooks: ok, error, not_question_bank or empty_or_invalid."""
    files = rows.groupBy("file").agg(F.max("error").alias("error"), F.coalesce(F.bool_or(F.col("sheet").isin(*SHEETS)), F.lit(False)).alias("bank"))
    counted = parsed(rows).groupBy("file").agg(F.count("question").alias("questions"), F.count("issue").alias("issues"))
    status = F.when(F.col("error").isNotNull(), "error").when(~F.col("bank"), "not_question_bank").when(F.coalesce("questions", F.lit(0)) == 0, "empty_or_invalid").otherwise("ok")
    zero = F.lit(0).cast("long")
    return files.join(counted, "file", "left").select("file", status.alias("status"), F.coalesce("questions", zero).alias("questions"), F.coalesce("issues", zero).alias("issues"))


def deduplicated(questions: DataFrame) -> DataFrame:
    """The first question (by file, sheet, row) of each kind, text, options and answer, with the number of `copies`."""
    key = F.sha2(F.concat_ws("::", "qtype", T.stripped("question"), F.array_join("options", "|"), T.stripped("answer")), 256)
    at = F.struct("file", "sheet", "row_num")
    return questions.where("question is not null").groupBy(key.alias("key")).agg(F.min_by(F.struct(*questions.columns), at).alias("q"), F.count(F.lit(1)).alias("copies")).select("q.*", "copies")
