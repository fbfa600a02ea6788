"""Queries of this subpackage: one for each operator, on its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import op1_licences, op2_decontaminate, op3_records, op4_near_dedup, op5_pieces, op6_nearest, op7_url_filter, op8_language, op9_substrings, op10_chat


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_licences_query(spark, sf_dir):
    return op1_licences.scan_licences(_read(spark, sf_dir, "documents"))


def op2_decontaminate_query(spark, sf_dir):
    return op2_decontaminate.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op3_records_query(spark, sf_dir):
    manifest = op3_records.write_records(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return op3_records.read_records(manifest)


def op4_near_dedup_query(spark, sf_dir):
    return op4_near_dedup.dedup(_read(spark, sf_dir, "documents"), k=3, percent=85)


def op5_pieces_query(spark, sf_dir):
    return op5_pieces.round_trip(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_nearest_query(spark, sf_dir):
    return op6_nearest.top_k(_read(spark, sf_dir, "embeddings"))


#: Dated entries of the production list: list, kind, entry, action, date.
ENTRIES = [
    ("ads", "domain", "casino-win.example.com", "add", "2024-01-10"),
    ("ads", "domain", "casino-win.example.com", "remove", "2024-05-01"),
    ("ads", "domain", "casino-win.example.com", "add", "2024-09-15"),
    ("ads", "domain", "free-bets.example.com", "add", "2024-03-01"),
    ("ads", "domain", "example.net", "add", "2024-06-01"),
    ("ads", "domain", "example.net", "remove", "2024-06-15"),
    ("pharma", "domain", "cheap-pills.example.com", "add", "2024-02-20"),
    ("pharma", "domain", "www.cheap-pills.example.com", "add", "2024-02-01"),
    ("pharma", "domain", "www.cheap-pills.example.com", "remove", "2024-04-01"),
    ("takedown", "prefix", "blog.tionsh.example.com/en", "add", "2024-07-01"),
    ("takedown", "prefix", "tionble.example.org/en", "add", "2024-01-01"),
    ("takedown", "prefix", "tionble.example.org/en", "remove", "2024-12-01"),
]


def dated_entries(pages: DataFrame) -> DataFrame:
    """The production list, and a host list drawn from the captures: by the first four hex digits h of md5(host),
    one host in five is added h mod 300 days into 2024 and, if h is even, removed 30 days later."""
    spark = pages.sparkSession
    fixed = spark.createDataFrame(ENTRIES, "list string, kind string, entry string, action string, at string").withColumn("at", F.col("at").cast("date"))
    host = op7_url_filter.host_of(F.col("url"))
    hosts = pages.select(host.alias("entry")).where("entry <> ''").distinct()
    h = F.conv(F.substring(F.md5("entry"), 1, 4), 16, 10).cast("int")
    drawn = hosts.withColumn("h", h).where("h % 5 = 0").withColumn("day", F.expr("date_add(date'2024-01-01', h % 300)"))
    kind = [F.lit("hosts").alias("list"), F.lit("domain").alias("kind"), "entry"]
    added = drawn.select(*kind, F.lit("add").alias("action"), F.col("day").alias("at"))
    removed = drawn.where("h % 2 = 0").select(*kind, F.lit("remove").alias("action"), F.expr("date_add(day, 30)").alias("at"))
    return fixed.unionByName(added).unionByName(removed)


def op7_url_filter_query(spark, sf_dir):
    """The table has no fetch time; a capture's is page_id mod 366 days into 2024."""
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_at", F.expr("date_add(date'2024-01-01', cast(pmod(page_id, 366) as int))"))
    return op7_url_filter.filter_urls(captures, dated_entries(pages))


def op8_language_query(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    return op8_language.predict(docs, op8_language.train(docs))


def op9_substrings_query(spark, sf_dir):
    return op9_substrings.dedup_substrings(_read(spark, sf_dir, "documents"), width=13)


def op10_chat_query(spark, sf_dir):
    odd = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    turns = op10_chat.canonical_rows(_read(spark, sf_dir, "conversations")).unionByName(op10_chat.canonical_rows(extra))
    return op10_chat.digests(op10_chat.format_chats(turns))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_licences": op1_licences_query, "op2_decontaminate": op2_decontaminate_query, "op3_records": op3_records_query, "op4_near_dedup": op4_near_dedup_query,
        "op5_pieces": op5_pieces_query, "op6_nearest": op6_nearest_query, "op7_url_filter": op7_url_filter_query, "op8_language": op8_language_query,
        "op9_substrings": op9_substrings_query, "op10_chat": op10_chat_query, "pipeline": pipeline,
    }
