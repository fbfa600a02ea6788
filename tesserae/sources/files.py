"""Files in and out: JSON lines, JSON documents, Markdown trees, banks as text, content hashes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.functions.text import number_answer, stripped

META = "struct<type:string,answer_letters:array<string>,options:array<string>,num_blanks:int,blanks:array<string>,num_keywords:int,keywords:array<string>,qid:bigint,bank:string>"
QA_SCHEMA = f"query string, expected_answer string, meta {META}"


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType = QA_SCHEMA) -> DataFrame:
    """JSON lines with a declared schema; a broken line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines without private columns (those with a leading _)."""
    df.drop(*[c for c in df.columns if c.startswith("_") and c not in ("_clean", "_curriculum", "_audit", "_sampling")]).write.mode("errorifexists").json(path)


def decoded(content: bytes) -> str:
    for encoding in ("utf-8-sig", "gb18030"):
        try:
            return content.decode(encoding)
        except UnicodeDecodeError:
            continue
    return content.decode("utf-8", "replace")


def read_markdown(spark: SparkSession, root: str) -> DataFrame:
    """source (path below root), text of all Markdown files; UTF-8 with or without mark, GB18030, else with replacements."""

    @F.pandas_udf("string")
    def decode(s: pd.Series) -> pd.Series:
        return s.map(decoded)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.lower("path").rlike(r"\.(md|markdown)$"))
    below = F.regexp_replace("path", r"^.*" + root.rstrip("/").rsplit("/", 1)[-1] + "/", "")
    return files.select(below.alias("source"), decode("content").alias("text"))


def content_hashes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), "length")


def math_rows(df: DataFrame) -> DataFrame:
    return df.select(F.col("question").alias("query"), number_answer(F.col("answer")).alias("expected_answer"))


def instruction_rows(df: DataFrame) -> DataFrame:
    prompt = F.when(stripped(F.coalesce("input", F.lit(""))) == "", F.col("instruction")).otherwise(F.concat_ws("\n\n", "instruction", "input"))
    return df.where("coalesce(instruction, '') <> '' and coalesce(output, '') <> ''").select(prompt.alias("input"), "output")


def short_rows(df: DataFrame) -> DataFrame:
    """Keyword rows (query, reference_keywords) as typed short rows; rows without either go."""
    words = F.filter(F.transform("reference_keywords", stripped), lambda w: w != "")
    return df.withColumn("w", words).where((stripped("query") != "") & (F.size("w") > 0)).select("query", F.concat(F.lit("[short] "), F.array_join("w", "|||")).alias("expected_answer"), F.size("w").alias("num_keywords"), F.col("w").alias("keywords"))


def write_bank(questions: DataFrame, path: str) -> None:
    """Questions as Markdown text by source, and as one flat CSV table."""
    options = F.array_join(F.transform("options", lambda o, i: F.concat(F.char(i + 65), F.lit(". "), o)), "\n")
    text = F.concat_ws("\n\n", F.concat(F.lit("## "), F.col("question")), F.nullif(options, F.lit("")), F.concat(F.lit("**"), F.col("answer"), F.lit("**")))
    questions.select("source", text.alias("value")).write.partitionBy("source").text(f"{path}/markdown")
    questions.select("qtype", "question", "answer", *[F.get("options", F.lit(i)).alias(f"option_{i + 1}") for i in range(12)]).write.option("header", True).csv(f"{path}/table")
