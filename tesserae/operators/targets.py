"""Rebuilt answers: evidence spans, literal quotes, validation of generated points, binding to what was seen."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tesserae.functions import text as T
from tesserae.operators.curation import first_reason
from tesserae.operators.retrieval import TRUSTED

# Terms and statements that say nothing, and patterns of cuts, comments, clauses and entities.
GENERIC_TERMS = "答案 要点 内容 相关 主要 可以 需要 进行 包括 通过 使用 方面 情况 answer point content related main include use".split()
GENERIC_STATEMENTS = "代码 设备 流程 操作 方法 步骤 参数 事件类型 略 无 na n/a /".split()
TRUNCATED = r"\.{2,}|。{2,}|…|⋯"
METADATA = r"(?is)\*?\[Image OCR\].*?\[End OCR\]\*?|<!--.*?-->"
CLAUSE = r"[^。！？!?；;\n]+([。！？!?；;]*)"
ENTITY = r"(?i)[A-Za-z][A-Za-z0-9+._/-]*|\d+(?:\.\d+)?(?:%|℃|°C|V|A|Pa|nm|um|μm)?"
LEADING_VERBS = r"^(?:请|简述|说明|分析|列举|比较|指出|回答)\s*"
RESERVED = ["|||", "\\boxed", "<search", "</search>", "{", "}"]


def content_terms(text: Column) -> Column:
    return F.filter(F.array_distinct(T.tokens(text)), lambda t: (F.length(t) >= 2) & ~t.isin(*GENERIC_TERMS))


def entities(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)), F.lower))


def _folded(text: str) -> tuple[str, list[int]]:
    """text in the evidence normal form, character by character, and where each of its characters came from."""
    pieces = [T.evidence_text(c) for c in text]
    return "".join(pieces), [i for i, p in enumerate(pieces) for _ in p]


def aligned_text(text: str | None, quote: str | None) -> str | None:
    """The part of text that quote stands for: itself, or the only part equal to it but for punctuation."""
    quote = (quote or "").strip()
    if not quote or text is None or re.search(TRUNCATED, quote):
        return None
    if quote in text:
        return quote
    wanted, (folded, origin) = T.evidence_text(quote), _folded(text)
    at = folded.find(wanted) if wanted else -1
    return text[origin[at] : origin[at + len(wanted) - 1] + 1] if at >= 0 and folded.rfind(wanted) == at else None


@F.pandas_udf(StringType())
def aligned(text: pd.Series, quote: pd.Series) -> pd.Series:
    return pd.Series([aligned_text(t, q) for t, q in zip(text, quote, strict=True)], dtype=object)


def span_texts(text: str | None, least: int = 12, most: int = 220, overlap: int = 40) -> list[str]:
    """Clauses of a text (long ones in overlapping parts) that can serve as quotes; comments don't end clauses.

    A line that ends without a mark is no clause, but for the last one.
    """
    text, out = text or "", []
    masked = re.sub(METADATA, lambda m: re.sub(r"[。！？!?；;\n]", " ", m[0]), text)
    last = len(masked.removesuffix("\n"))
    for m in re.finditer(CLAUSE, masked):
        if not m[1] and m.end() < last:
            continue
        clause = text[m.start() : m.end()].strip()
        if len(T.evidence_text(clause)) <= most:
            parts = [clause]
        else:
            starts = range(0, max(1, len(clause) - overlap), most - overlap)
            parts = [clause[i : i + most].strip() for i in starts]
        for part in (p.strip("…").strip() for p in parts):
            if not re.search(TRUNCATED, part) and least <= len(T.evidence_text(part)) <= most:
                out.append(part)
    return out


@F.pandas_udf(ArrayType(StringType()))
def spans_of(text: pd.Series) -> pd.Series:
    return text.map(span_texts)


def evidence_spans(evidence: DataFrame, by: str = "target_id") -> DataFrame:
    """by, span_id, evidence_id, quote, source, heading, quality_category of evidence (those columns and text).

    A quote that a set's evidence has more than once is its first one's. Spans are numbered S001, ... within a
    set; a set is what one question retrieved, so its window is small.
    """
    cut = evidence.select(by, "evidence_id", "source", "heading", "quality_category", F.posexplode(spans_of("text")).alias("pos", "quote"))
    first = cut.groupBy(by, "quote").agg(F.min(F.struct("evidence_id", "pos", "source", "heading", "quality_category")).alias("e"))
    at = F.row_number().over(Window.partitionBy(by).orderBy("e.evidence_id", "e.pos"))
    return first.select(by, F.format_string("S%03d", at).alias("span_id"), "e.evidence_id", "quote", "e.source", "e.heading", "e.quality_category")


def _canonical(c: Column, letter: str, width: int) -> Column:
    number = F.regexp_extract(c, f"^[{letter}{letter.lower()}]0*(\\d+)$", 1)
    return F.when(number != "", F.format_string(f"{letter}%0{width}d", number.try_cast("long"))).otherwise(c)


def canonical_span(c: Column) -> Column:
    return _canonical(T.stripped(c), "S", 3)


def canonical_evidence(c: Column) -> Column:
    return _canonical(T.stripped(c), "E", 2)


def materialized(points: DataFrame, spans: DataFrame, by: str = "target_id") -> DataFrame:
    """points (by, index, span_id, statement) with the evidence and quote of their spans; unknown: reason unknown_span."""
    known = spans.select(by, "span_id", "evidence_id", "quote")
    return points.withColumn("span_id", canonical_span(F.col("span_id"))).join(known, [by, "span_id"], "left").withColumn("reason", F.when(F.col("quote").isNull(), "unknown_span"))


def point_rejection(statement: Column, quote: Column, question: Column, evidence: Column) -> Column:
    """Why a statement isn't backed by its quote, or null; the first test that fails names the reason."""
    said, cited, asked = content_terms(statement), content_terms(quote), content_terms(question)
    n, m, shared = F.length(T.evidence_norm(statement)), F.length(T.evidence_norm(quote)), F.size(F.array_intersect(said, cited))
    reserved = F.exists(F.array(*[F.lit(r) for r in RESERVED]), lambda r: F.contains(statement, r))
    return first_reason(
        (~n.between(8, 240), "statement_length"), (T.evidence_norm(statement).isin(*GENERIC_STATEMENTS), "generic_statement"), (reserved, "reserved_statement_syntax"),
        (~m.between(12, 220), "quote_length"), (F.contains(quote, F.lit("…")) | ~F.contains(evidence, quote), "quote_not_exact"),
        (shared < 2, "insufficient_statement_quote_overlap"), (shared / F.size(said) < 0.35, "low_statement_quote_overlap"),
        (F.size(F.array_except(said, asked)) == 0, "question_restatement"),
        (F.size(F.array_except(entities(statement), F.concat(entities(quote), entities(question)))) > 0, "unsupported_statement_entities"),
    )


def validated(targets: DataFrame, points: DataFrame, evidence: DataFrame) -> DataFrame:
    """target_id, reason, points for all targets (target_id, question, decision); reason is accepted or why not.

    points has target_id, index (from 1), statement, evidence_id, quote; evidence has target_id, evidence_id,
    text, source, heading, quality_category. Points are judged as rows and only then gathered: a target of more
    than six is refused by its count, so no array grows.
    """
    sizes = points.groupBy("target_id").agg(F.count(F.lit(1)).alias("n"))
    sized = targets.join(sizes, "target_id", "left").withColumn("early", first_reason((F.coalesce("decision", F.lit("")) != "answerable", "teacher_rejected"), (~F.coalesce("n", F.lit(0)).between(2, 6), "point_count")))
    open_ = points.join(sized.where("early is null").select("target_id", "question"), "target_id")
    known = evidence.select("target_id", F.col("evidence_id").alias("known"), "text", "source", "heading", "quality_category")
    # an id as given comes before its canonical form
    asked = open_.withColumn("known", F.explode(F.array_distinct(F.array(T.stripped("evidence_id"), canonical_evidence(F.col("evidence_id"))))))
    met = asked.join(known, ["target_id", "known"], "left").withColumn("order", F.struct(F.col("text").isNull(), T.stripped("evidence_id") != F.col("known")))
    fields = ["statement", "known", "quote", "text", "source", "heading", "quality_category", "question"]
    best = met.groupBy("target_id", "index").agg(F.min_by(F.struct(*fields), "order").alias("p")).select("target_id", "index", "p.*")
    best = best.withColumn("statement", T.stripped(F.coalesce("statement", F.lit("")))).withColumn("exact", aligned("text", "quote"))
    why = first_reason((F.col("text").isNull(), "unknown_evidence"), (~F.col("quality_category").isin(*TRUSTED), "untrusted_evidence"), (F.col("exact").isNull(), "quote_not_exact"))
    judged = best.withColumn("why", F.coalesce(why, point_rejection(F.col("statement"), F.col("exact"), F.col("question"), F.col("text"))))
    repaired = F.when(F.col("exact") == T.stripped("quote"), "exact").otherwise("punctuation_repaired")
    point = F.struct("index", "statement", F.col("known").alias("evidence_id"), F.col("exact").alias("quote"), repaired.alias("quote_alignment"), "source", "heading", "quality_category")
    failed = F.min(F.when(F.col("why").isNotNull(), F.struct("index", "why")))
    gathered = judged.groupBy("target_id").agg(failed.alias("failed"), F.array_sort(F.collect_list(point)).alias("points"), F.collect_list(content_terms(F.col("statement"))).alias("terms"))
    alike = F.exists(
        F.when(F.size("terms") > 1, F.sequence(F.lit(1), F.size("terms") - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.exists(F.slice("terms", i + 1, F.size("terms")), lambda t: F.size(F.array_intersect(t, F.element_at("terms", i))) >= 0.8 * F.greatest(F.size(F.array_union(t, F.element_at("terms", i))), F.lit(1))),
    )
    late = F.coalesce(F.concat(F.lit("point_"), F.col("failed.index").cast("string"), F.lit(":"), F.col("failed.why")), F.when(alike, "near_duplicate_points"), F.lit("accepted"))
    out = sized.join(gathered.select("target_id", late.alias("late"), "points"), "target_id", "left").withColumn("reason", F.coalesce("early", "late"))
    return out.select("target_id", "reason", F.when(F.col("reason") == "accepted", F.col("points")).alias("points"))


def verifier_accepts(payload: Column, n: Column) -> Column:
    """Does a verifier's JSON text accept each of the n points?"""
    v = F.from_json(payload, "decision string, complete boolean, point_checks array<struct<index:int,supported:boolean,relevant:boolean>>")
    checks = v.point_checks
    every = F.forall(checks, lambda c: F.coalesce(c.supported & c.relevant, F.lit(False)))
    indexes = F.array_sort(F.transform(checks, lambda c: c["index"])) == F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    return F.coalesce((v.decision == "accept") & v.complete & (F.size(checks) == n) & every & indexes, F.lit(False))


def quote_hits(text: Column, points: Column) -> Column:
    """Indexes from 0 of points (index, quote) whose quote is in the text."""
    return F.transform(F.filter(points, lambda p: F.contains(text, p.quote)), lambda p: p["index"] - 1)


def bound(points: DataFrame, results: DataFrame) -> DataFrame:
    """points (target_id, index, quote) with visible_supports: the trusted results that show the quote.

    results has target_id, hop, observation, rank, source, heading, quality_category, text. The join is by target;
    a point without a support keeps an empty array, which callers refuse.
    """
    seen = results.where(F.col("quality_category").isin(*TRUSTED))
    met = points.select("target_id", "index", "quote").join(seen, "target_id").where((F.col("quote") != "") & F.contains("observation", F.col("quote")) & F.contains("text", F.col("quote")))
    supports = met.groupBy("target_id", "index").agg(F.array_sort(F.collect_list(F.struct("hop", "rank", "source", "heading", "quality_category"))).alias("visible_supports"))
    return points.join(supports, ["target_id", "index"], "left").withColumn("visible_supports", F.coalesce("visible_supports", F.from_json(F.lit("[]"), supports.schema["visible_supports"].dataType)))


def query_candidates(question: Column, most: int = 8) -> Column:
    """Queries out of a question's own words: the whole context, then its clauses, each once, leading verbs cut."""
    context = T.stripped(F.substring(T.question_context(question), 1, 256))
    clauses = F.transform(F.split(context, r"[\n\r，,。；;：:、！？!?（）()]+"), lambda c: T.stripped(F.regexp_replace(T.stripped(c), LEADING_VERBS, "")))
    every = F.concat(F.array(context), F.filter(clauses, lambda c: F.length(T.answer_free(c)) >= 4))
    keys = F.transform(every, lambda c: F.lower(T.collapsed(c)))
    once = F.filter(every, lambda c, i: F.array_position(keys, F.get(keys, i)) == i + 1)
    return F.when(context == "", F.array().cast("array<string>")).otherwise(F.slice(once, 1, most))


def _long_terms(text: Column) -> Column:
    return F.filter(F.array_distinct(T.tokens(text)), lambda t: F.length(t) >= 2)


def leak_points(expected: Column) -> Column:
    """The alternatives of an open gold string as they are, each as a point (statement, quote)."""
    parts = F.filter(F.transform(F.split(T.gold_payload(expected), r"\|\|\||[/／]"), T.stripped), lambda x: x != "")
    return F.when(T.gold_type(expected).isin("fill", "short"), F.transform(parts, lambda x: F.struct(x.alias("statement"), x.alias("quote")))).otherwise(F.from_json(F.lit("[]"), "array<struct<statement:string,quote:string>>"))


def term_leak(query: Column, context: Column, points: Column) -> Column:
    """Does a query hold a point (statement, quote) whole, or a term of both its texts, that its visible context lacks?"""
    q, c = T.answer_free(query), T.answer_free(context)
    new = lambda a: (T.answer_free(a) != "") & F.contains(q, T.answer_free(a)) & ~F.contains(c, T.answer_free(a))
    terms = F.flatten(F.transform(points, lambda p: F.array_intersect(_long_terms(p.statement), _long_terms(p.quote))))
    return F.exists(points, lambda p: new(p.statement) | new(p.quote)) | (F.size(F.array_except(F.array_intersect(_long_terms(query), terms), _long_terms(context))) > 0)


def question_leak(question: Column, points: Column) -> Column:
    """Does a question give a point away: whole, by two of its terms, or by one of four characters and more?"""
    q, asked = T.answer_free(question), _long_terms(question)

    def leaks(p):
        shared = F.array_intersect(asked, _long_terms(p.statement))
        return ((T.answer_free(p.statement) != "") & F.contains(q, T.answer_free(p.statement))) | (F.size(shared) >= 2) | F.exists(shared, lambda t: F.length(t) >= 4)

    return F.exists(points, leaks)
