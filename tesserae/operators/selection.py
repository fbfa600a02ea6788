"""Selection of training rows by the evidence a search shows for them, checks of verdicts and objective rows, flat maps."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from tesserae.functions import messages as M
from tesserae.functions import text as T
from tesserae.operators import retrieval, scoring
from tesserae.operators.curation import first_reason, issues

# Fields of a critic's verdict.
VERDICT_FIELDS = ["decision", "confidence", "complete_natural_statement", "meaningful_answer", "noise", "reason"]
NOISE_FIELDS = ["table_fragment", "ppt_or_slide_fragment", "header_footer_or_copyright", "ocr_corruption", "machine_translation", "truncated_fragment", "button_or_operation_fragment", "product_or_code_identifier", "other_noise"]
# Words that name a model's role.
EMBEDDING_HINTS, RERANKER_HINTS = r"bge|e5|gte|embed|jina|sentence-transform", r"rerank|cross-encoder"
OBJECTIVE = ("single", "multiple", "bool")


# ---------------------------------------------------------------- status, role, evidence


def status(displayed: Column, pool: Column) -> Column:
    """What the first results that a model sees, and the whole pool, cover of a question's points."""
    return F.when(displayed >= 1.0, "ready_one_search").when(pool >= 1.0, "needs_query_rewrite").when(F.greatest(displayed, pool) > 0.0, "partial_review").otherwise("excluded_unsupported")


def role(status_: Column) -> Column:
    return F.when(status_.isin("ready_one_search", "needs_query_rewrite"), "primary").when(status_ == "partial_review", "secondary").otherwise("excluded")


def recommended_turns(status_: Column) -> Column:
    return F.when(status_ == "ready_one_search", 1).when(status_ == "needs_query_rewrite", 2)


def evidence_records(results: DataFrame, most: int = 14) -> DataFrame:
    """query_id, evidence_id (E01 and so on), source, heading, quality_category, score, raw_score, text of results
    (query_id, query, rank, source, heading, quality_category, score, raw_score, text): the first of each source and
    heading that can be trusted, if its passage about the query has 24 characters."""
    first = Window.partitionBy("query_id", "source", "heading").orderBy("rank")
    own = results.where(~F.col("quality_category").isin("question-only", "noise")).withColumn("_n", F.row_number().over(first)).where("_n = 1")
    own = own.withColumn("text", T.snippet(F.col("text"), F.col("query"), 360)).where(F.length(T.stripped("text")) >= 24)
    placed = own.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("_n") <= most)
    return placed.select("query_id", F.format_string("E%02d", "_n").alias("evidence_id"), "source", "heading", "quality_category", "score", "raw_score", "text")


def candidates(chunk: DataFrame | retrieval.Index, rows: DataFrame, first: int = 4, pool: int = 20, depth: int = 50, shown: int = 1800, per_result: int = 360) -> DataFrame:
    """For each open row (row_id, query, expected_answer, bank, declared_support): coverage of its points by what the
    first results show and by the pool, status, role, searches, both sets of hits, the shown text and all result records.

    One search serves all rows. A row without a result is covered by nothing."""
    context = F.substring(T.question_context(F.col("query")), 1, 256)
    asked = rows.select("row_id", "query", "expected_answer", "bank", "declared_support", context.alias("first_search_query"), T.keypoints(F.col("expected_answer")).alias("keypoints"), T.gold_type(F.col("expected_answer")).alias("question_type")).where(F.size("keypoints") > 0)
    asked = asked.withColumn("retrieval_query", T.retrieval_query(F.col("first_search_query"), F.col("query"), F.col("bank")))
    queries = asked.select(F.col("row_id").alias("query_id"), F.col("retrieval_query").alias("query"))
    found = retrieval.search(chunk, queries, top_k=pool, candidate_k=depth, quality_rerank=True, fields=("heading", "text")).join(asked.select(F.col("row_id").alias("query_id"), "keypoints", "retrieval_query"), "query_id")
    trusted = F.col("quality_category").isin(*retrieval.TRUSTED)
    hits = F.when(trusted, T.keypoint_hits(T.answer_free(F.col("text")), F.col("keypoints"))).otherwise(F.array().cast("array<int>"))
    found = found.withColumn("keypoint_hits", hits)
    record = F.struct("rank", "source", "heading", "quality_category", "quality_weight", "raw_score", "keypoint_hits", "text")
    per = found.groupBy("query_id").agg(F.array_sort(F.collect_list(record)).alias("results"))  # `pool` of a row at most
    seen = found.where(F.col("rank") <= first).select("query_id", "rank", "source", "heading", "raw_score", T.snippet(F.col("text"), F.col("retrieval_query"), per_result).alias("snippet"))
    output = M.observations(seen, shown).select("query_id", F.col("observation").alias("first_retrieval_output"))
    out = asked.withColumnRenamed("row_id", "query_id").join(per, "query_id", "left").join(output, "query_id", "left")
    # points that the texts of the pool hold together count, too
    held = F.array_join(F.transform(F.filter("results", lambda r: r.quality_category.isin(*retrieval.TRUSTED)), lambda r: r.text), "\n")
    held = F.size(T.keypoint_hits(T.answer_free(F.coalesce(held, F.lit(""))), F.col("keypoints")))
    out = out.withColumn("pool_coverage", held / F.size("keypoints"))
    output = F.coalesce("first_retrieval_output", F.lit(M.NO_RESULTS))
    shown_hits = T.keypoint_hits(T.answer_free(M.visible_text(output)), F.col("keypoints"))
    out = out.withColumns({"first_retrieval_output": output, "first_hits": shown_hits}).withColumn("first_coverage", F.size("first_hits") / F.size("keypoints"))
    state = status(F.col("first_coverage"), F.col("pool_coverage"))
    out = out.withColumn("selection_status", state).withColumn("recomputed_support", retrieval.support_level(F.col("pool_coverage")))
    return out.select(
        F.col("query_id").alias("row_id"), "question_type", "query", "expected_answer", "bank", "keypoints", "declared_support", "recomputed_support", (F.col("declared_support") != F.col("recomputed_support")).alias("support_mismatch"),
        "selection_status", role(F.col("selection_status")).alias("dataset_role"), recommended_turns(F.col("selection_status")).alias("recommended_search_turns"), "first_search_query", "retrieval_query", "first_coverage", "pool_coverage",
        "first_hits", "first_retrieval_output", "results",
    )


def signature(results: Column) -> Column:
    """(source, heading, text) of each result, to compare two searches by."""
    return F.transform(results, lambda r: F.struct(r.source.alias("source"), r.heading.alias("heading"), r.text.alias("text")))


def first_is_question(results: Column) -> Column:
    """1 if the first result is of class question-only, else 0."""
    return F.when(F.try_element_at(results, F.lit(1)).quality_category == "question-only", 1).otherwise(0)


# ---------------------------------------------------------------- verdicts and objective rows


def verdict_issue(raw: Column) -> Column:
    """What is wrong with a critic's JSON verdict (the first of its faults), or null: fields exactly as asked for, of
    their kinds, and a decision that agrees with the rest."""
    return T.let(T.stripped(raw), lambda own: T.let(F.try_parse_json(own), lambda v: _verdict_issue(own, v)))


def _verdict_issue(own: Column, v: Column) -> Column:
    """Of a text and its JSON value, which is parsed once for all the tests."""
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    text = lambda path: F.try_variant_get(v, path, "string")
    flag = lambda path: F.try_variant_get(v, path, "boolean")
    keys = lambda c: F.coalesce(F.array_sort(F.json_object_keys(c)), F.array().cast("array<string>"))
    wanted = lambda names: F.array(*[F.lit(n) for n in sorted(names)])
    number = F.coalesce(kind("$.confidence").rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.lit(False))
    noise = [f"$.noise.{n}" for n in NOISE_FIELDS]
    boolean = lambda path: F.coalesce(kind(path) == "BOOLEAN", F.lit(False))
    clean = flag("$.complete_natural_statement") & flag("$.meaningful_answer")
    all_boolean = F.lit(True)
    for path in noise:
        clean, all_boolean = clean & ~flag(path), all_boolean & boolean(path)
    reason = F.length(T.stripped(text("$.reason")))
    return first_reason(
        (v.isNull(), "invalid_json"), (~F.coalesce(kind("$").startswith("OBJECT"), F.lit(False)), "schema_not_object"), (keys(own) != wanted(VERDICT_FIELDS), "schema_fields"),
        (~F.coalesce(text("$.decision").isin("accept", "reject") & (kind("$.decision") == "STRING"), F.lit(False)), "schema_decision"),
        (~number | ~F.coalesce(F.try_variant_get(v, "$.confidence", "double").between(0, 1), F.lit(False)), "schema_confidence"),
        (~boolean("$.complete_natural_statement"), "schema_complete_statement"), (~boolean("$.meaningful_answer"), "schema_meaningful_answer"),
        (keys(F.get_json_object(own, "$.noise")) != wanted(NOISE_FIELDS), "schema_noise_fields"), (~all_boolean, "schema_noise_type"),
        (~F.coalesce((kind("$.reason") == "STRING") & reason.between(1, 240), F.lit(False)), "schema_reason"), ((text("$.decision") == "accept") != clean, "schema_contradiction"),
    )


def objective_issues(query: Column, expected: Column, messages: Column, overlap: Column) -> Column:
    """Issues of an objective training row; messages is an array of (role, content) or null, overlap whether it is an
    official question (null: not known)."""
    pattern = r"(?sU)^\s*\[(single|multiple|bool)\]\s*(.+?)\s*$"
    kind, answer = F.regexp_extract(expected, pattern, 1), F.regexp_extract(expected, pattern, 2)
    options, letters = F.array_distinct(F.regexp_extract_all(query, F.lit(r"(?mU)^\s*([A-Z])\.\s*.+?\s*$"), F.lit(1))), T.letters(answer)
    final = F.coalesce(F.try_element_at(messages, F.lit(-1)).content, F.lit(""))
    with_messages = issues(
        (~F.coalesce(F.transform(messages, lambda m: m.role) == F.array(F.lit("user"), F.lit("assistant")), F.lit(False)), "invalid_runtime_roles"),
        (~F.contains(final, F.lit("\\boxed{")), "missing_boxed_answer"), (~F.contains(final, T.stripped(answer)), "boxed_answer_mismatch"), (~F.coalesce(~overlap, F.lit(False)), "official_overlap_not_cleared"),
    )
    row = issues((F.size(options) == 0, "missing_options"), (F.size(letters) == 0, "missing_answer_letters"), ((F.size(options) > 0) & (F.size(F.array_except(letters, options)) > 0), "answer_out_of_range"), (kind.isin("single", "bool") & (F.size(letters) != 1), "non_unique_answer"))
    return F.when(F.coalesce(kind, F.lit("")) == "", F.array(F.lit("invalid_expected_answer"))).otherwise(F.concat(row, F.when(messages.isNull(), F.array(F.lit("missing_messages"))).otherwise(with_messages)))


def short_match(expected: Column, completion: Column, boxed: Column) -> Column:
    """Indexes from 0 of a short gold string's keywords that the rule finds in a completion, with what it finds."""
    keywords = F.filter(F.split(T.stripped(T.gold_payload(expected)), r"\|\|\|"), lambda k: T.stripped(k) != "")
    keywords = F.when(T.gold_type(expected) == "short", keywords).otherwise(F.array().cast("array<string>"))
    seen = F.concat_ws("|", T.answer_norm(F.coalesce(boxed, F.lit(""))), T.answer_norm(completion))
    found = F.transform(keywords, lambda k, i: F.struct(i.alias("index"), k.alias("keyword"), F.array_sort(F.filter(scoring.alternatives(k), lambda a: F.contains(seen, a))).alias("alternatives")))
    return F.filter(found, lambda x: F.size(x.alternatives) > 0)


def objective_share(kind: Column, split: Column) -> Column:
    """Share of objective rows among those of the training split."""
    return F.coalesce(F.avg(F.when(split == "train", kind.isin(*OBJECTIVE).cast("double"))), F.lit(0.0))


def distinct_texts(values: Column) -> Column:
    """Values without repeats by their evidence form, without marks at their ends, of 256 characters at most, in order."""
    own = F.transform(values, lambda v: F.regexp_replace(F.regexp_replace(v, r"(?U)\s+", " "), "^[ ，,。；;：:]+|[ ，,。；;：:]+$", ""))
    keyed = F.transform(own, lambda v: F.struct(v.alias("text"), T.answer_free(v).alias("key")))
    return F.transform(T.firsts(F.filter(keyed, lambda x: x.key != ""), lambda x: x.key), lambda x: F.substring(x.text, 1, 256))


def model_roles(name: Column) -> Column:
    low = F.lower(name)
    found = F.array_compact(F.array(F.when(low.rlike(EMBEDDING_HINTS), "embedding"), F.when(low.rlike(RERANKER_HINTS), "reranker")))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("generative_or_unknown")))


def gpu_index(key: Column) -> Column:
    """The number in keys such as gpu.3.memory; else null."""
    return F.regexp_extract(key, r"^gpu\.(\d+)(?:\.|$)", 1).try_cast("int")


def final_response(responses: Column) -> Column:
    """The last response that has a box, else the last one, else an empty text."""
    return F.coalesce(F.try_element_at(F.filter(responses, lambda r: r.rlike(r"\\boxed\s*\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}")), F.lit(-1)), F.try_element_at(responses, F.lit(-1)), F.lit(""))


def gain_summary(rows: DataFrame) -> DataFrame:
    """One row of counts and means of records (robust_points, fragile, first_coverage, robust_hits, robust_gain,
    raw_gain, robust_full, raw_full): coverage of rows with robust points before and after, rows that gain."""
    robust = F.col("robust_points") > 0
    mean = lambda c: F.coalesce(F.round(F.avg(F.when(robust, c)), 6), F.lit(0.0))
    return rows.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(robust).alias("evaluable"), F.count_if("fragile").alias("fragile_rows"), mean(F.col("first_coverage")).alias("mean_before"),
        mean(F.col("robust_hits") / F.nullif(F.col("robust_points"), F.lit(0))).alias("mean_after"), F.count_if(F.col("robust_gain") > 0).alias("robust_incremental"), F.count_if(F.col("raw_gain") > 0).alias("raw_incremental"),
        F.count_if("robust_full").alias("robust_full_gain"), F.count_if("raw_full").alias("raw_full_gain"),
    )


# ---------------------------------------------------------------- flat maps


def flat_columns(kind: S.StructType, prefix: str = "") -> list[Column]:
    """A column for each leaf of nested structs, named by its dotted path."""
    out: list[Column] = []
    for f in kind.fields:
        path = f"{prefix}.{f.name}" if prefix else f.name
        name = ".".join(f"`{p}`" for p in path.split("."))
        out += flat_columns(f.dataType, path) if isinstance(f.dataType, S.StructType) else [F.col(name).alias(path)]
    return out


def flattened(text: Column, indexes: bool = False) -> Column:
    """A JSON object as a map from dotted paths to texts; null for anything else. Lists stay as JSON texts or, with
    indexes, are walked with [i] in the path. An empty object or walked list has no entry; null is the text null."""

    @F.pandas_udf("map<string,string>")
    def walk(s: pd.Series) -> pd.Series:
        def leaves(value, path):
            if isinstance(value, dict):
                return [x for k, v in value.items() for x in leaves(v, f"{path}.{k}" if path else k)]
            if indexes and isinstance(value, list):
                return [x for i, v in enumerate(value) for x in leaves(v, f"{path}[{i}]")]
            return [(path, value if isinstance(value, str) else json.dumps(value, ensure_ascii=False))]

        def one(text):
            try:
                value = json.loads(text) if text is not None else None
            except ValueError:
                return None
            return dict(leaves(value, "")) if isinstance(value, dict) else None

        return s.map(one).astype(object)

    return walk(text)


def last_parameters(rows: DataFrame) -> DataFrame:
    """run, key, value: hyper-parameters (run, at, params as JSON) flattened, the last write of a key counts."""
    own = rows.select("run", "at", F.explode(flattened(F.col("params"))).alias("key", "value"))
    return own.groupBy("run", "key").agg(F.max_by("value", F.struct("at", "value")).alias("value"))
