"""Cloze questions from sentences: answers, quality checks, masking, prompts and pairs for two searches."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import text as T
from tesserae.operators.curation import issues
from tesserae.operators.retrieval import quality_category
from tesserae.operators.sampling import ordered

# Patterns of answers, of sentences that don't stand alone, and answers that are too common.
SENTENCE_END = r"(?<=[。！？!?；;])|\n+"
NUMERIC = r"(?i)(?<![A-Za-z0-9])\d+(?:\.\d+)?\s*(?:nm|um|μm|µm|mm|cm|℃|°C|mV|V|mA|A|W|kW|%|ppm|颗|次|小时|分钟|秒|片|个|层)(?![A-Za-z0-9])"
ACRONYM = r"(?<![A-Za-z0-9])[A-Z][A-Z0-9+./-]{2,14}(?![A-Za-z0-9])"
QUOTED = r"[“\"]([\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]{2,12})[”\"]"
IDEOGRAPH, ENGLISH_WORD = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]", r"\b[A-Za-z]{2,}\b"
PREDICATE = (
    r"(?i)是|为|指|称为|叫做|用于|用来|通过|控制|表示|检测|测量|计算|定义|包括|小于|大于|不超过|不少于|范围|厚度|温度|精度|浓度|时间|距离|产生|形成|实现|负责|管理|记录|解决|"
    r"\b(?:is|are|means|stands\s+for|used|controls?|measures?|calculates?|loads?|contains?|consists?|defined|requires?|records?)\b"
)
FRAGMENTS = [
    ("boilerplate_or_slide_noise", r"(?i)slide\s+number|###\s*notes|<!--|<html|copyright|all\s+rights|prior\s+consent|own\s+risk|equivalent\s+to\s+rev|new\s+york.*london|\\n"),
    ("markup_fragment", r"^\s*(?:--|<|\|)"), ("slide_bullet_fragment", r"^\s*(?:-\s+|[–—•●▪►✓]\s*)"), ("context_dependent_fragment", r"^(?:其次|上表中|如下|上述)"),
    ("numbered_instruction_fragment", r"^\s*\d+(?:[.)]\s*|(?=[A-Z]))"),
    ("button_or_operation_fragment", r"(?i)依次点击|再点击|点击.*(?:确认|密码)|\b(?:MAIN\s+MENU|MENU\s+screen|button|0/1\s+switch|check\s+that)\b|^(?:check|make\s+sure|ensure|press|select|click|enter|turn)\b"),
    ("shift_log_fragment", r"(?i)\b(?:suffer|follow|rework)\b|值班|写case"), ("acknowledgement_fragment", r"(?i)感谢.*(?:资助|支持)|\b(?:acknowledg|funded\s+by|supported\s+by)\b"),
    ("english_predicate_fragment", r"(?i)^(?:measures?|controls?|calculates?|records?|loads?|uses?|provides?)\b"),
]
COMPLETE_END = r"[。！？!?.)）\]】]$"
COMPLETE_ENGLISH = r"(?i)\b(?:is|are|means|stands\s+for|was|were|has|have|can|will|shall|requires?|contains?|consists?)\b"
BANNED_SOURCE = r"(?i)试题|试卷|考题|题库|考试|练习题|测验|答案|certify|quiz|exam"
BANNED_ANSWERS = ["fab", "wafer", "lot", "job", "step", "item", "system", "server", "new", "note", "page", "pac", "pdf", "rev", "sop", "pe", "yes", "no"]
BANNED_SENTENCE = r"【|____|答案"
PROMPT_HEAD = "下面是一道技术资料填空题，共 %d 个空。请先检索资料，再按编号顺序填写。\n把最终答案放入 \\boxed{}，各空用“;”分隔。\n\n题目：\n"
BLANK = "【1】"
WINDOW, SENTENCE_LENGTH = 100, (28, 220)


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, SENTENCE_END), T.collapsed), lambda s: s != "")


def _count(text: Column, part: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)


def answers(sentence: Column) -> Column:
    """(kind, answer) of a sentence: quantities, acronyms and quoted terms that it has once, each once, in that order."""
    kinds = [("numeric_unit", NUMERIC, 0), ("acronym", ACRONYM, 0), ("quoted_term", QUOTED, 1)]

    def named(kind, pattern, group):
        return F.transform(F.regexp_extract_all(sentence, F.lit(pattern), F.lit(group)), lambda a: F.struct(F.lit(kind).alias("kind"), T.stripped(a).alias("answer")))

    found = F.concat(*[named(*k) for k in kinds])
    once = F.filter(found, lambda a: _count(F.lower(sentence), F.lower(a.answer)) == 1)
    usable = lambda key: F.length(key).between(2, 40) & ~key.isin(*BANNED_ANSWERS)
    return T.firsts(F.filter(once, lambda a: T.let(T.answer_free(a.answer), usable)), lambda a: T.answer_free(a.answer))


def _sentence_faults(sentence: Column) -> list[tuple[Column, str]]:
    count = lambda p: F.size(F.regexp_extract_all(sentence, F.lit(p), F.lit(0)))
    ideographs, english = count(IDEOGRAPH), count(ENGLISH_WORD)
    return [
        *[(sentence.rlike(p), name) for name, p in FRAGMENTS],
        ((_count(sentence, F.lit("|")) >= 2) | (_count(sentence, F.lit("\t")) >= 2), "table_fragment"), (~sentence.rlike(COMPLETE_END), "missing_sentence_terminator"),
        ((ideographs == 0) & (english > 0) & ~sentence.rlike(COMPLETE_ENGLISH), "english_title_fragment"),
        ((ideographs < 10) & (english < 8), "insufficient_sentence_context"), (~sentence.rlike(PREDICATE), "missing_semantic_predicate"),
    ]


def _answer_faults(sentence: Column, answer: Column, kind: Column) -> list[tuple[Column, str]]:
    at = F.locate("\x00", F.replace(F.lower(sentence), F.lower(answer), F.lit("\x00")))
    hyphen = (at > 0) & ((F.substring(sentence, at - 1, F.lit(1)) == "-") & (at > 1) | (F.substring(sentence, at + F.length(answer), F.lit(1)) == "-") | answer.startswith("-") | answer.endswith("-"))
    return [
        ((kind == "acronym") & ~answer.rlike("^[A-Z]{3,10}$"), "code_like_acronym"), ((kind == "acronym") & T.answer_free(answer).isin(*BANNED_ANSWERS), "generic_acronym"),
        ((kind == "acronym") & hyphen, "hyphen_fragment"), ((kind == "numeric_unit") & F.replace(answer, F.lit(" "), F.lit("")).rlike(r"^0[1-9]\d*(?!\.)"), "malformed_leading_zero"),
        ((kind == "quoted_term") & ~sentence.rlike("是|为|指|称为|叫做|所谓|方法|工艺"), "ungrounded_quoted_term"),
    ]


def quality_issues(sentence: Column, answer: Column, kind: Column) -> Column:
    """The names of all reasons why a sentence and answer make no question by themselves, sorted."""
    return F.array_sort(F.array_distinct(issues(*_sentence_faults(sentence), *_answer_faults(sentence, answer, kind))))


def replaced_once(text: Column, part: Column, by: str) -> Column:
    """text with the first occurrence of part, in any case, replaced."""
    at = F.instr(F.lower(text), F.lower(part))
    return F.when((at > 0) & (part != ""), F.concat(F.substring(text, F.lit(1), at - 1), F.lit(by), F.substring(text, at + F.length(part), F.length(text)))).otherwise(text)


def prompt(masked: Column) -> Column:
    """A fill question of masked sentences, numbered with their blanks."""
    lines = F.transform(masked, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), F.replace(s, F.lit(BLANK), F.concat(F.lit("【"), (i + 1).cast("string"), F.lit("】")))))
    return F.concat(F.format_string(PROMPT_HEAD, F.size(masked)), F.array_join(lines, "\n"))


def model_query(heading: Column, masked: Column, answer: Column) -> Column:
    return F.substring(T.collapsed(F.concat_ws(" ", replaced_once(F.coalesce(heading, F.lit("")), answer, ""), F.replace(masked, F.lit(BLANK), F.lit("待填")))), 1, 256)


def candidates(chunk: DataFrame, per_source: int = 3) -> DataFrame:
    """candidate_id, source, heading, sentence, masked_sentence, answer, answer_kind, model_query of chunks
    (chunk_id, source, heading, text) of class reference: the first acceptable answer of a sentence of 28 to 220 characters
    that has no blank and speaks of no answer itself, up to per_source of a source.

    Sentences are in the order of chunk and place; a sentence that chunks share counts once. Faults of a sentence are looked
    for before it is sent on, answers only in one copy of it, since they don't depend on its place. The limit by source
    is the operator's feature. It is a rank-limited window, so Spark keeps per_source rows of a source before it
    shuffles them.
    """
    reference = quality_category(F.col("source"), F.col("heading"), F.col("text")) == "reference"
    rows = chunk.where(~F.col("source").rlike(BANNED_SOURCE) & reference).select("chunk_id", "source", "heading", F.posexplode(sentences(F.col("text"))).alias("pos", "sentence"))
    sentence = F.col("sentence")
    sound = [~fault for fault, _ in _sentence_faults(sentence)]
    kinds = sentence.rlike(NUMERIC) | sentence.rlike(ACRONYM) | sentence.rlike(QUOTED)
    rows = rows.where(reduce(and_, [F.length(sentence).between(*SENTENCE_LENGTH), ~sentence.rlike(BANNED_SENTENCE), kinds, *sound]))
    once = rows.groupBy(F.sha2("sentence", 256).alias("candidate_id")).agg(F.min(F.struct("chunk_id", "pos", "source", "heading", "sentence")).alias("c")).select("candidate_id", "c.*")
    good = F.filter(answers(sentence), lambda a: ~reduce(or_, [fault for fault, _ in _answer_faults(sentence, a.answer, a.kind)]))
    first = once.withColumn("a", F.get(good, 0)).where("a is not null")
    few = first.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy("chunk_id", "pos"))).where(F.col("r") <= per_source)
    masked = replaced_once(F.col("sentence"), F.col("a.answer"), BLANK)
    out = few.select("candidate_id", "source", "heading", "sentence", masked.alias("masked_sentence"), F.col("a.answer").alias("answer"), F.col("a.kind").alias("answer_kind"))
    return out.withColumn("model_query", model_query(F.col("heading"), F.col("masked_sentence"), F.col("answer")))


def can_pair(a: str, b: str) -> Column:
    """May rows aliased a and b be one question? Their answers differ and neither is in the prompt or a query.

    The normal form drops and folds single characters, so that of a prompt is made of its parts' forms, which
    are there once for each row and not for each pair.
    """
    x, y = F.col(f"{a}.key"), F.col(f"{b}.key")
    head = T.answer_free(F.format_string(PROMPT_HEAD, F.lit(2)))
    texts = F.concat_ws("\n", F.concat(head, F.lit("1"), F.col(f"{a}.one"), F.lit("2"), F.col(f"{b}.two")), F.col(f"{a}.asked"), F.col(f"{b}.asked"))
    return (F.col(f"{a}.source") != F.col(f"{b}.source")) & (x != "") & (y != "") & (x != y) & ~F.contains(texts, x) & ~F.contains(texts, y)


def pairs(rows: DataFrame) -> DataFrame:
    """split, first, second: each candidate (candidate_id, split, source, masked_sentence, answer, model_query) with
    the first of the 99 after it, in a ring by id, that it can be paired with; no pair twice.

    Rows meet in blocks of one window, so a row meets 200 others at most. A pair could come twice only in a ring
    under 199 rows; those are settled in turn, one small task a split. Pools are numbered in buckets of ids.
    """
    sizes = rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"))  # one row a split
    placed = ordered(rows, ["split"], "candidate_id", "place").join(F.broadcast(sizes), "split").select("candidate_id", "split", "source", T.answer_free(F.col("masked_sentence")).alias("one"), T.answer_free(F.replace(F.col("masked_sentence"), F.lit(BLANK), F.lit("2"))).alias("two"), T.answer_free(F.col("answer")).alias("key"), T.answer_free(F.coalesce("model_query", F.lit(""))).alias("asked"), (F.col("place") - 1).alias("at"), "n")
    block = F.floor(F.col("at") / WINDOW)
    # the ring's first rows follow its last ones: they also stand n places further on
    wrapped = placed.unionByName(placed.where(F.col("at") < WINDOW - 1).withColumn("at", F.col("at") + F.col("n")))
    left = placed.withColumn("block", F.explode(F.array_distinct(F.array(block, block + 1)))).alias("a")
    right = wrapped.withColumn("block", block).alias("b")
    step = F.col("b.at") - F.col("a.at")
    met = left.join(right, (F.col("a.split") == F.col("b.split")) & (F.col("a.block") == F.col("b.block"))).where(step.between(1, WINDOW - 1) & (step < F.col("a.n")) & can_pair("a", "b"))
    every = met.select(F.col("a.split").alias("split"), F.col("a.n").alias("n"), F.col("a.at").alias("at"), step.alias("step"), F.col("a.candidate_id").alias("first"), F.col("b.candidate_id").alias("second"))
    large = every.where(f"n >= {2 * WINDOW - 1}").groupBy("split", "first").agg(F.min_by("second", "step").alias("second"))

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(), []
        for _, options in pdf.sort_values(["at", "step"]).groupby("at"):
            for r in options.itertuples():
                if frozenset((r.first, r.second)) not in taken:
                    taken.add(frozenset((r.first, r.second)))
                    out.append((r.split, r.first, r.second))
                    break
        return pd.DataFrame(out, columns=["split", "first", "second"])

    kinds = ", ".join(f"{n} {t}" for n, t in (("split", rows.schema["split"].dataType.simpleString()), ("first", rows.schema["candidate_id"].dataType.simpleString()), ("second", rows.schema["candidate_id"].dataType.simpleString())))
    return large.unionByName(every.where(f"n < {2 * WINDOW - 1}").groupBy("split").applyInPandas(settle, kinds))
