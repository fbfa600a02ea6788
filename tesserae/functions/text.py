"""Text expressions: tokens, query building, gold strings, normalisers, log lines and bank cells.

All are Column expressions but the few that Spark has no function for (NFKC, balanced braces), which are
Arrow-batched pandas UDFs.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Terms that carry no meaning in questions.
STOP_TERMS = ["一道", "下面", "作答", "分析", "最终", "答案", "字母", "选项", "题目", "填入", "多个", "所有", "please", "answer", "question"]
# Terms of two characters and more, in one pattern without a test of their length; and ideographs.
WORD = r"[a-z0-9]{2,}(?:[._+#/-][a-z0-9]+)*|[a-z0-9](?:[._+#/-][a-z0-9]+)+"
IDEOGRAPHS = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]"
# Kinds of tasks that no text can answer, in order of precedence.
NON_TEXT_TASKS = [("screenshot", r"截图|截屏|screen\s*shot"), ("upload", r"上传|upload"), ("draw", r"画出|绘制|补充.*图|示意图|乌龟图"), ("write_code", r"编写.*代码|写出.*代码|代码实现|实现以下.*(?:程序|函数)")]
# Groups of equivalent answers.
SYNONYMS = [
    ["对", "正确", "是", "yes", "true", "√"], ["错", "错误", "否", "no", "false", "×"], ["拒收", "reject", "退货"], ["特采", "waive", "让步接收"], ["放行", "release", "合格放行"],
    ["晶圆", "wafer", "硅片"], ["光刻胶", "光阻", "photoresist", "resist"], ["退火", "anneal", "annealing"], ["掺杂", "doping", "dopant"], ["离子注入", "ion implantation", "implant"],
]
# Punctuation that each of the two normalisers deletes.
EVIDENCE_PUNCTUATION = r"[\s，,。．.、；;：:！!？?\"'`（）()【】\[\]{}<>]+"
ANSWER_PUNCTUATION = r"[，,。．\.、；;：:！!？\?\"'`（）()【】\[\]/／\\\s]+"


_WORD, _IDEOGRAPHS = re.compile(WORD), re.compile("[\u3400-\u4dbf\u4e00-\u9fff]+")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is computed once for a row however often body and its lambdas name it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), 0)


def firsts(values: Column, key: Callable[[Column], Column]) -> Column:
    """An array without elements whose key is that of one before, or null; a key is computed once for each element."""
    keyed = F.transform(values, lambda x: F.struct(x.alias("value"), key(x).alias("key")))
    return let(keyed, lambda k: F.transform(F.filter(k, lambda x, i: F.array_position(k.getField("key"), x.key) == i + 1), lambda x: x.value))


def stripped(c: Column | str) -> Column:
    """Without white space of any kind at both ends. (As a function of one argument it is safe in F.transform,
    which hands a second one the index.)"""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapsed(c: Column) -> Column:
    return stripped(F.regexp_replace(c, r"(?U)\s+", " "))


def tokens(text: Column) -> Column:
    """The bag of terms of a mixed text: words and joined forms, and of each ideograph run its characters, pairs and the run itself if short."""
    low, none = F.lower(text), F.array().cast("array<string>")
    words = F.regexp_extract_all(low, F.lit(WORD), F.lit(0))
    runs = F.regexp_extract_all(low, F.lit(IDEOGRAPHS + "+"), F.lit(0))

    def grams(run):
        n = F.length(run)
        one = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(run, i, F.lit(1)))
        two = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(run, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
        own = F.when(n.between(2, 6), F.array(run)).otherwise(F.array().cast("array<string>"))
        return F.concat(one, two, own)

    # lambdas run for each term, so texts without stop words and ideographs do without them
    free = lambda terms: F.filter(terms, lambda t: ~t.isin(*STOP_TERMS))
    stops = [F.contains(low, F.lit(w)) for w in STOP_TERMS if w.isascii()]
    kept = F.when(low.rlike(IDEOGRAPHS), free(F.concat(words, F.flatten(F.transform(runs, grams))))).when(reduce(or_, stops), free(words)).otherwise(words)
    return F.coalesce(kept, none)


_KIND, _LOW = np.zeros(256, np.uint8), np.arange(256, dtype=np.uint8)
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 1
_KIND[[*b"._+#/-"]] = 2
_KIND[0xE3:0xEA] = 3  # lead bytes of ideographs and their neighbours
_LOW[65:91] += 32
#: Bytes of text whose terms are found in one step; a longer text is a step of its own.
STEP = 1 << 20


def terms_of(texts: pa.Array) -> Iterator[tuple[int, int, pa.Array, np.ndarray]]:
    """The terms of tokens() in texts of a batch, some texts at a time: number of the first text and of texts, terms, and
    of each the text it is from (from 0). Scans use it, since it finds words by the bytes of many texts at once.

    A word is a run of letters, digits and single joining marks between these; only two other characters have a letter of
    these as their lower case. Texts with ideographs are taken one by one.
    """
    texts = pc.binary_join_element_wise(texts.cast(pa.string()).fill_null(""), "\n", "")
    if pc.any(pc.match_substring_regex(texts, "[\u0130\u212a]")).as_py():
        texts = pc.replace_substring(pc.replace_substring(texts, "\u0130", "i\u0307"), "\u212a", "k")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    stops, at = pa.array(STOP_TERMS), 0
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + STEP, "right")) - 1)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[at] : bounds[to]]
        begins = bounds[at : to + 1] - bounds[at]
        kind = _KIND[data]
        word = kind == 1
        wide = np.unique(np.searchsorted(begins, np.flatnonzero(kind == 3), "right") - 1)
        marks = np.flatnonzero(kind == 2)
        word[marks[word[marks - 1] & word[marks + 1]]] = True  # each text ends with a line end
        for i in wide:
            word[begins[i] : begins[i + 1]] = False
        edges = np.flatnonzero(np.diff(word, prepend=False))
        starts, length = edges[::2], edges[1::2] - edges[::2]
        word[starts[length == 1]] = False
        starts, length = starts[length > 1], length[length > 1]
        ends = np.zeros(len(length) + 1, np.int32)
        np.cumsum(length, out=ends[1:])
        words = pa.StringArray.from_buffers(len(length), pa.py_buffer(ends), pa.py_buffer(_LOW[data[word]]))
        row = np.repeat(np.arange(to - at), np.diff(np.searchsorted(starts, begins)))
        if len(wide):
            own = [_terms(texts[at + int(i)].as_py()) for i in wide]
            words, row = pa.concat_arrays([words, *[pa.array(x, pa.string()) for x in own]]), np.concatenate([row, np.repeat(wide, [len(x) for x in own])])
        keep = pc.invert(pc.is_in(words, value_set=stops))
        yield at, to - at, words.filter(keep), row[keep.to_numpy(zero_copy_only=False)]
        at = to


def _terms(text: str) -> list[str]:
    """tokens() of one text, stop terms included."""
    low = text.lower()
    out = _WORD.findall(low)
    for run in _IDEOGRAPHS.findall(low):
        out += [*run, *(run[i : i + 2] for i in range(len(run) - 1)), *([run] if 2 <= len(run) <= 6 else [])]
    return out


def search_query(text: Column, most: int = 256) -> Column:
    """The last search action, closed or trailing; null where there is none, empty where it is blank."""
    after = F.element_at(F.split(text, r"(?iU)<search(?:\s[^>]*)?>"), -1)
    inside = F.element_at(F.split(after, r"(?iU)</search\s*>"), 1)
    return F.when(text.rlike(r"(?iU)<search(?:\s[^>]*)?>"), F.substring(collapsed(inside), 1, most))


def question_context(query: Column) -> Column:
    marked = F.regexp_extract(query, r"(?isU)题目\s*[：:]\s*(.*?)(?=\n\s*选项\s*[：:]|\z)", 1)
    return F.when(query.rlike(r"(?U)题目\s*[：:]"), collapsed(marked)).otherwise(collapsed(query))


def retrieval_query(model: Column, original: Column, bank: Column) -> Column:
    parts = F.array(collapsed(F.coalesce(model, F.lit(""))), question_context(F.coalesce(original, F.lit(""))), collapsed(F.coalesce(bank, F.lit(""))))
    return F.array_join(F.array_distinct(F.filter(parts, lambda x: x != "")), "\n")


def snippet(text: Column, query: Column, limit: int) -> Column:
    """A passage of at most `limit` characters about the earliest query term; ellipses stand outside the limit."""
    terms = F.filter(F.array_distinct(tokens(query)), lambda t: F.length(t) >= 2)

    def passage(flat):
        first = let(F.lower(flat), lambda low: F.array_min(F.filter(F.transform(terms, lambda t: F.instr(low, t) - 1), lambda p: p >= 0)))
        return let(first, lambda at: let(F.least(F.length(flat), F.greatest(F.lit(0), F.coalesce(at, F.lit(0)) - limit // 3) + limit), lambda end: cut(flat, end)))

    def cut(flat, end):
        start = F.greatest(F.lit(0), end - limit)
        return F.concat(F.when(start > 0, "…").otherwise(""), stripped(F.substring(flat, start + 1, F.lit(limit))), F.when(end < F.length(flat), "…").otherwise(""))

    return let(collapsed(text), lambda flat: F.when(F.length(flat) <= limit, flat).otherwise(passage(flat)))


# ---------------------------------------------------------------- normalisers and gold strings


def evidence_text(value: str | None) -> str | None:
    if value is None:
        return None
    folded = unicodedata.normalize("NFKC", value).lower().replace("\u03bc", "u").replace("\u00b5", "u")
    return re.sub(EVIDENCE_PUNCTUATION, "", folded)


@F.pandas_udf(StringType())
def evidence_norm(s: pd.Series) -> pd.Series:
    """NFKC, lower case, micro signs as u, without white space and punctuation; slashes stay."""
    return s.map(evidence_text, na_action="ignore")


def answer_norm(c: Column) -> Column:
    """The other normaliser: no NFKC, and slashes go too."""
    return F.regexp_replace(F.lower(stripped(c)), "(?U)" + ANSWER_PUNCTUATION, "")


def gold_type(expected: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(expected, r"(?U)^\s*\[(\w+)\]", 1)), F.lit("")), F.lit("unknown"))


def gold_payload(expected: Column) -> Column:
    return F.regexp_extract(expected, r"(?sU)^\s*\[\w+\]\s*(.*)$", 1)


def keypoints(expected: Column) -> Column:
    """Points of an open gold answer, each with its alternatives normalised, longest first; else empty."""

    def point(p):
        parts = F.filter(F.array_distinct(F.transform(F.split(p, "[/／]"), answer_free)), lambda x: x != "")
        return F.array_sort(parts, lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).otherwise(F.when(a < b, -1).when(a > b, 1).otherwise(0)))

    points = F.filter(F.transform(F.split(gold_payload(expected), r"\|\|\|"), point), lambda p: F.size(p) > 0)
    return F.when(gold_type(expected).isin("fill", "short"), points).otherwise(F.array().cast("array<array<string>>"))


def answer_free(c: Column) -> Column:
    """evidence_norm for texts that are in NFKC already, as an expression."""
    return F.regexp_replace(F.translate(F.lower(c), "\u03bc\u00b5", "uu"), "(?U)" + EVIDENCE_PUNCTUATION, "")


def keypoint_hits(text: Column, points: Column) -> Column:
    """Indexes from 0 of points with an alternative in the (normalised) text."""
    all_ = F.when(F.size(points) > 0, F.sequence(F.lit(0), F.size(points) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(all_, lambda i: F.exists(F.element_at(points, i + 1), lambda a: F.contains(text, a)))


def fragile_keypoints(points: Column) -> Column:
    all_ = F.when(F.size(points) > 0, F.sequence(F.lit(0), F.size(points) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(all_, lambda i: F.coalesce(F.array_max(F.transform(F.element_at(points, i + 1), F.length)), F.lit(0)) <= 1)


def fingerprint(query: Column) -> Column:
    return F.sha2(evidence_norm(question_context(query)), 256)


def letters(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.upper(c), F.lit("[A-Z]"), F.lit(0)))


def canonical_answer(expected: Column) -> Column:
    """First alternatives of an open answer joined by semicolons, other payloads as they are; null if unusable."""
    payload = stripped(gold_payload(expected))
    firsts = F.transform(F.split(payload, r"\|\|\|"), lambda p: F.try_element_at(F.filter(F.transform(F.split(p, "[/／]"), stripped), lambda x: x != ""), F.lit(1)))
    kind = gold_type(expected)
    return F.nullif(F.when(kind.isin("fill", "short"), F.array_join(F.array_compact(firsts), "; ")).when(kind.isin("single", "multiple", "bool"), payload), F.lit(""))


def non_text_task(query: Column) -> Column:
    context, out = question_context(query), F.lit(None).cast("string")
    for name, pattern in reversed(NON_TEXT_TASKS):
        out = F.when(context.rlike("(?i)" + pattern), name).otherwise(out)
    return out


def balanced(text: str, start: int) -> int:
    """Where the brace that is open before `start` closes, or -1."""
    depth = 1
    for m in re.compile(r"[{}]").finditer(text, start):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.start()
    return -1


def boxed_text(text: str | None) -> str | None:
    out = None
    for m in re.finditer(r"\\boxed\s*\{", text or ""):
        if (end := balanced(text, m.end())) >= 0:
            out = text[m.end() : end]
    return out


@F.pandas_udf(StringType())
def boxed(s: pd.Series) -> pd.Series:
    """The content of the last balanced box."""
    return s.map(boxed_text).astype(object).where(lambda x: x.notna(), None)


@F.pandas_udf(StringType())
def first_json_object(s: pd.Series) -> pd.Series:
    """The first JSON object of a model's text, after thoughts; fences and other text around it don't matter."""

    def find(text):
        text = re.sub(r"(?s)<think>.*?</think>", "", text or "")
        decoder = json.JSONDecoder()
        for m in re.finditer(r"\{", text):
            try:
                value, _ = decoder.raw_decode(text, m.start())
            except ValueError:
                continue
            return json.dumps(value, ensure_ascii=False, sort_keys=True)
        return None

    return s.map(find).astype(object).where(lambda x: x.notna(), None)


# ---------------------------------------------------------------- log lines, banks, model texts


def clean_log_line(line: Column, now: Column) -> Column:
    """Without terminal codes and worker prefixes; a line without a time of its own gets `now`."""
    bare = F.regexp_replace(F.regexp_replace(line, "\\x1b\\[[0-9;]*[A-Za-z]", ""), r"\[(?:\d{1,3};)*\d{1,3}m", "")
    bare = F.ltrim(F.regexp_replace(bare, r"^(?:\s*\([A-Za-z_][\w.:-]*\s+pid=\d+[^)]*\)\s*){1,2}", ""))
    partial = r"^(INFO|WARNING|ERROR|DEBUG)\s+(\d{2}-\d{2} \d{2}:\d{2}:\d{2})\s*"
    rebuilt = F.concat_ws(" ", F.concat(F.date_format(now, "yyyy-"), F.regexp_extract(bare, partial, 2)), stripped(F.concat_ws(" ", F.regexp_extract(bare, partial, 1), F.regexp_replace(bare, partial, ""))))
    return F.when(stripped(bare) == "", line).when(bare.rlike(r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}"), bare).when(bare.rlike(partial), rebuilt).otherwise(F.concat_ws(" ", F.date_format(now, "yyyy-MM-dd HH:mm:ss"), bare))


def clean_log_text(text: Column, now: Column) -> Column:
    """clean_log_line of each line; line ends stay as they are."""
    lines = F.regexp_extract_all(text, F.lit(r"[^\r\n]*(?:\r\n|\n|\r)|[^\r\n]+"), F.lit(0))
    ends = lambda x: F.regexp_extract(x, r"([\r\n]*)$", 1)
    return F.array_join(F.transform(lines, lambda x: F.concat(clean_log_line(F.regexp_replace(x, r"[\r\n]+$", ""), now), ends(x))), "")


def without_space(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s", "")


def clean_cell(c: Column) -> Column:
    return F.regexp_replace(F.translate(stripped(F.regexp_replace(c, "\u00a0", " ")), "\u200b\u200c\u200d\ufeff", ""), r"(?U)\s+", " ")


def choice_answer(raw: Column, single: bool) -> Column:
    found = F.array_distinct(F.regexp_extract_all(F.upper(raw), F.lit("[A-L]"), F.lit(0)))
    return F.nullif(F.array_join(F.slice(found, 1, 1) if single else found, ""), F.lit(""))


def judge_answer(raw: Column) -> Column:
    low = F.lower(stripped(raw))
    return F.when(low.isin("对", "正确", "是", "√", "true", "t", "a", "yes", "y"), "对").when(low.isin("错", "错误", "不对", "否", "×", "false", "f", "b", "no", "n"), "错")


def score_of_payload(text: Column) -> Column:
    """A judge's score in [0, 1]: the field of that name, else the first number of its own from 0 to 1."""
    named = F.regexp_extract(text, r'"score"\s*:\s*"?([01](?:\.\d+)?)', 1)
    free = F.regexp_extract(text, r"(?:^|[^\d.])([01](?:\.\d+)?)(?![\d.])", 1)
    score = F.coalesce(F.nullif(named, F.lit("")), F.nullif(free, F.lit(""))).try_cast("double")
    return F.when(score.between(0.0, 1.0), score)


def number_answer(c: Column) -> Column:
    """What follows #### without thousands separators, else the trimmed text."""
    return F.when(F.contains(c, F.lit("####")), F.replace(stripped(F.regexp_extract(c, r"####\s*([^\n]+)", 1)), F.lit(","), F.lit(""))).otherwise(stripped(c))


def bigram_similarity(a: Column, b: Column) -> Column:
    """Jaccard of sets of character pairs; 1 for two empty texts."""

    def pairs(c):
        n = F.length(c)
        return F.when(n == 0, F.array().cast("array<string>")).when(n <= 2, F.array(c)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(c, i, F.lit(2)))))

    x, y = pairs(a), pairs(b)
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def hash_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256)
