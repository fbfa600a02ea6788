"""A corpus pipeline of five stages over `documents`; a part of tesserae.llm.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which run()
writes to the shared folder and reads again as the next one's docs. All but the last return the columns of docs.

Language ID learns from the documents of sf_dir that have a language, not from the stage's own docs, so a
document's decision doesn't depend on what came before. Near-dedup works on five-word shingles with a
similarity of 0.8. A document whose text is all repeats of earlier ones goes in the third stage.
"""

from __future__ import annotations

import public_tokenizers

from tesserae.llm import op2_decontaminate, op4_near_dedup, op5_pieces, op8_language, op9_substrings
from tesserae.llm.common import stored


def language(spark, docs, sf_dir):
    """Keeps documents in a learned language. Null and empty texts and texts without letters go; a null doc_id stays."""
    known = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = op8_language.train(known)
    return op8_language.keep_known(docs, model, own=op8_language.least_scores(known, model))


def near_dedup(spark, docs, sf_dir):
    """Keeps one row of each group of near copies, of the least doc_id (null last). Texts without words all stay."""
    return op4_near_dedup.keep_one(docs, k=5, percent=80)


def substrings(spark, docs, sf_dir):
    """Takes out passages of 50 words and more that start in a document with a smaller doc_id; a text of nothing else
    goes. Rows with a null doc_id stay as they are, and null and empty texts, too."""
    return op9_substrings.remove_repeats(docs, width=50)


def decontaminate(spark, docs, sf_dir):
    """Keeps documents without a window of ten words (or a whole shorter item) of the benchmark, also null texts."""
    return op2_decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces(spark, docs, sf_dir):
    """doc_id, n_pieces and ids of each row; a null or empty text has none."""
    return op5_pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("language", language), ("near_dedup", near_dedup), ("substrings", substrings), ("decontaminate", decontaminate), ("pieces", pieces)]

#: Language ID and SentencePiece can't be put in SQL; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over `documents` of sf_dir, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
