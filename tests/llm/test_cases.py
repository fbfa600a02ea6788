"""Odd cases of every operator (empty tables, clashing columns, very long texts, null ids) and stages against brute force."""

import json
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import op1_licences, op2_decontaminate, op3_records, op4_near_dedup, op5_pieces, op7_url_filter, op8_language, op9_substrings, op10_chat
from tesserae.llm.common import Words

tokenizers_dir = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.01"
PIECES, BYTES = "piece_bpe_32k.model", "byte_bpe_50k.json"
MIT = "Released under the MIT License."


def clashing(df):
    """With columns that have the names operators use for their own."""
    names = ["pid", "pos", "k", "row", "n", "h", "g", "v", "ids", "shard", "score", "licence", "items", "part", "salt", "key", "component", "fingerprint"]
    return df.withColumns({c: F.lit(c) for c in names if c not in df.columns})


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    long_ = " ".join(f"word{i % 977}" for i in range(200_000))
    rows = [(1, f"a b\n{MIT}", "en"), (2, None, "en"), (3, "", None), (4, long_ + " " + MIT, "en"), (5, MIT, None), (5, MIT, None), (None, MIT, "en"), (6, " \n\t", "xx"), (7, "x" * 300_000, "en"), (8, "日本語 ▁ a  b", "ja")]
    path = str(tmp_path_factory.mktemp("odd"))
    clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string")).repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_licences(docs):
    got = sorted(docs_ for docs_ in map(tuple, op1_licences.scan_licences(docs).collect()) if docs_[0] is not None)
    assert got == [(i, "MIT", 1.0, "MIT") if i in (1, 4, 5) else (i, None, 0.0, "") for i in (1, 2, 3, 4, 5, 5, 6, 7, 8)]
    assert op1_licences.scan_licences(docs).where("doc_id is null").first().licence == "MIT"
    assert op1_licences.scan_licences(docs.limit(0)).collect() == []


def test_words_are_hashed_alike_in_any_block(monkeypatch):
    from tesserae.llm import common

    texts = [b"some words " * 50, None, b"x" * 400, b"", b"some x"]
    whole = Words(texts).hashes()
    monkeypatch.setattr(common, "CHUNK_BYTES", 37)
    assert (Words(texts).hashes() == whole).all()


def viterbi(normal, s, unknown):
    """Best score of a path through s, by plain dynamic programming over all pieces."""
    longest = max(map(len, normal))
    best = [0.0] + [-np.inf] * len(s)
    for e in range(1, len(s) + 1):
        for b in range(max(0, e - longest), e):
            if s[b:e] in normal:
                best[e] = max(best[e], best[b] + normal[s[b:e]])
        if s[e - 1] not in normal:
            best[e] = max(best[e], best[e - 1] + unknown)
    return best[-1]


def test_pieces_are_best_paths(spark):
    """The score of each whole text's path is that of a plain Viterbi, and decoding gives the text again."""
    import sentencepiece

    path = tokenizers_dir.path(PIECES)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    normal = {model.id_to_piece(i): -math.log(100 - model.get_score(i)) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
    unknown = min(normal.values()) - 10.0
    texts = [t for (t,) in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").select("text").limit(60).collect() if t] + ["日本語 zz\u1234q  two  spaces ", "word " * 3000, "x" * 20_000, "\u2581mark", "a\tb\nc"]
    pieces = op5_pieces.Pieces.load(path)
    for t in texts:
        data = np.frombuffer(pieces.encode(t), np.int32).tolist()
        score = sum(normal[model.id_to_piece(i)] for i in data if not model.is_byte(i))
        s = "\u2581" + t.replace(" ", "\u2581")
        score += unknown * sum(c not in normal for c in s)
        assert abs(score - viterbi(normal, s, unknown)) < 1e-6 * max(1, abs(score))
        assert pieces.decode(pieces.encode(t)) == t.replace("\u2581", " ")


def test_plain_english_is_encoded_as_by_the_library():
    import sentencepiece

    path = tokenizers_dir.path(PIECES)
    model, pieces = sentencepiece.SentencePieceProcessor(model_file=path), op5_pieces.Pieces.load(path)
    for word in "the people government international development important questions understanding between different communities which together happened yesterday".split():
        assert np.frombuffer(pieces.encode(word), np.int32).tolist() == model.encode(word)


def test_pieces_of_odd_rows(docs):
    path = tokenizers_dir.path(PIECES)
    got = {r.doc_id: r for r in op5_pieces.round_trip(docs, path).collect()}
    assert got[2].n_pieces == got[3].n_pieces == 0 and not got[8].restored and all(r.restored for i, r in got.items() if i != 8) and None in got
    assert op5_pieces.round_trip(docs.limit(0), path).collect() == []


def test_encoder_is_that_of_whole_texts():
    """Every pair of odd texts, first with unknown words, then with known ones, then after a reset."""
    encoder = op3_records.Encoder(tokenizers_dir.path(BYTES))
    odd = ["", "  ", " a", "a ", "a  b", "\n", "x", "a\n\nb c", "<|endoftext|> a b <|endoftext|>", "é, ü. 日本 語!! x y z", "a" * 100 + ", b " + "q" * 70, "it's don't 's 't", "a \tb", " ".join(["w,"] * 450), "x 1, 2. a1, _b, c_."]
    odd += [x + " " + y for x in odd for y in odd]
    want = encoder._packed(odd)
    assert encoder.encode(odd) == want and encoder.encode(odd[::-1]) == want[::-1]
    encoder._forget()
    assert encoder.encode(odd) == want and encoder.encode([]) == []


def test_records_of_odd_rows(docs):
    path = tokenizers_dir.path(BYTES)
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in op3_records.read_records(op3_records.write_records(docs, path)).collect()}
    for r in docs.where("doc_id is not null").collect():
        ids = np.array([*plain.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
    assert op3_records.read_records(op3_records.write_records(docs.limit(0), path)).collect() == []


def test_every_shard_is_a_task(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id long, text string").repartition(3)
    manifest = op3_records.write_records(docs, tokenizers_dir.path(BYTES), shards=16)
    assert [r.shard for r in manifest.orderBy("shard").collect()] == list(range(16)) and manifest.agg(F.sum("n_docs")).first()[0] == 200


def test_language_held_out_accuracy(spark):
    docs = clashing(spark.read.parquet(f"{SF}/documents.parquet"))
    got = op8_language.predict(docs, op8_language.train(docs)).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null").collect()
    assert len(got) > 250 and sum(r.lang_pred == r.lang for r in got) >= 0.95 * len(got)


def test_language_of_odd_rows(docs):
    model = op8_language.train(docs)
    got = {r.doc_id: r for r in op8_language.predict(docs, model).collect()}
    assert got[2].lang_pred == got[3].lang_pred == got[6].lang_pred == "und" and set(model.languages) <= {"en", "ja", "xx"}
    assert got[None].held_out is None and all(0 <= r.score <= 1 for r in got.values())


def test_sample_is_the_smallest_hashes(spark):
    """Also where one language holds nearly all rows, of which only those under a bound are ordered."""
    rows = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 1000 == 7, "b").otherwise("a").alias("lang"))
    hashed = rows.withColumn("h", F.xxhash64("doc_id")).collect()
    want = {r.doc_id for lang in "ab" for r in sorted((r for r in hashed if r.lang == lang), key=lambda r: r.h)[:100]}
    assert op8_language._sampled(rows, 100) == want


def test_language_stage_keeps_what_it_knows(spark):
    """keep_known against the same rule row by row."""
    docs = clashing(spark.read.parquet(f"{SF}/documents.parquet"))
    model = op8_language.train(docs)
    own = op8_language.least_scores(docs, model)
    want = []
    for r in docs.select("doc_id", "text").collect():
        lang, score, n = model.ranked(r.text.encode() if r.text is not None else None)
        if lang != "und" and score >= max(0.1, own[lang] - max(1, n) ** -0.5):
            want.append(r.doc_id)
    kept = op8_language.keep_known(docs, model, own=own)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(want)


def test_decontaminate_stage_keeps_clean_documents(spark, docs):
    item = " ".join(f"w{i}" for i in range(12))
    bench = spark.createDataFrame([(1, item), (2, MIT), (3, None)], "item_id long, text string")
    kept = op2_decontaminate.keep_clean(docs, bench)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["2", "3", "6", "7", "8"]
    assert op2_decontaminate.keep_clean(docs, bench.limit(0)).count() == docs.count()
    assert op2_decontaminate.decontaminate(docs.limit(0), bench).collect() == []


def test_search_confirms_words_whose_hashes_meet(monkeypatch):
    """With hashes of two bits almost everything is a candidate; direct comparison still finds occurrences alone."""
    right = Words.hashes
    monkeypatch.setattr(Words, "hashes", lambda self, seed=0: right(self, seed) & np.uint64(3))
    r = np.random.default_rng(2)
    texts = [" ".join(f"w{i}" for i in r.integers(0, 5, n)).encode() for n in (400, 3, 0, 30)]
    items = [(str(n), " ".join(f"w{i}" for i in r.integers(0, 5, n)).encode()) for n in (1, 2, 3, 4, 5, 12, 3)] + [("sub", b" ".join(texts[0].split()[50:65]))]
    for t, (n, ranges, names) in zip(texts, op2_decontaminate.Searcher(items).search(texts), strict=True):
        w, hit, own = t.split(), set(), set()
        for name, item in items:
            x = item.split()
            m = min(10, len(x))
            for s in range(len(x) - m + 1):
                for i in range(len(w) - m + 1):
                    if w[i : i + m] == x[s : s + m]:
                        hit |= set(range(i, i + m))
                        own.add(name)
        assert (n, {i for a, b in ranges for i in range(a, b)}, names) == (len(w), hit, own)


def test_large_group_of_near_copies(spark):
    """Copies of copies around one text, some of them all of the same change, beside texts that share passages; all links count."""
    r = np.random.default_rng(8)
    draw = lambda n: [f"v{i}" for i in r.integers(0, 5000, n)]
    base, passage, texts = draw(130), draw(50), []
    families = [base] + [[*base[:at], *draw(12), *base[at + 12 :]] for at in (10, 60, 100)]
    for i in range(700):
        w = list(families[i % 4])
        for at in r.integers(0, len(w), r.integers(0, 7)):
            w[at] = f"u{r.integers(0, 30)}" if i % 3 else f"own{i}"
        texts.append(w)
    texts += [draw(30) + passage + draw(int(r.integers(5, 60))) for _ in range(150)]
    texts += [passage + draw(int(r.integers(0, 6))) for _ in range(60)]
    sets = [frozenset(zip(w, w[1:], w[2:], strict=False)) for w in texts]
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n) and root(a) != root(b):
                up[max(root(a), root(b))] = min(root(a), root(b))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {x.doc_id: x.component_id for x in op4_near_dedup.dedup(df, 3, 85).collect()}
    assert got == {i: root(i) for i in range(len(sets))}


def test_url_filter_on_empty_and_clashing_tables(spark):
    entries = clashing(spark.createDataFrame([("l", "domain", "bad.com", "add", "2024-01-10")], "list string, kind string, entry string, action string, at string").withColumn("at", F.col("at").cast("date")))
    captures = clashing(spark.createDataFrame([(1, "http://bad.com/" + "p/" * 500, "2024-02-01"), (None, "http://bad.com", "2024-02-01")], "page_id long, url string, d string").withColumn("fetched_at", F.col("d").cast("date")))
    got = op7_url_filter.filter_urls(captures, entries).collect()
    assert [(r.blocked, r.matches) for r in got] == [(True, "l:domain:bad.com")] * 2
    assert not any(r.blocked for r in op7_url_filter.filter_urls(captures, entries.limit(0)).collect())
    assert op7_url_filter.filter_urls(captures.limit(0), entries).collect() == []


def test_chat_on_empty_table_and_layouts_with_further_fields(spark):
    turns = clashing(spark.createDataFrame([(1, 0, "user", "x" * 3_000_000)], "conv_id long, turn long, role string, text string"))
    assert op10_chat.digests(op10_chat.format_chats(op10_chat.canonical_rows(turns))).first().n_turns == 1
    assert op10_chat.digests(op10_chat.format_chats(op10_chat.canonical_rows(turns.limit(0)))).collect() == []
    records = [{"prompt": "p", "completion": "c", "id": 7}, {"messages": [{"role": "user", "content": "u", "name": "n"}, {"role": "assistant", "content": "a"}], "meta": {"x": [1]}}, {"prompt": "p", "completion": "c", "question": "q"}, {"instruction": "i", "input": None, "output": "o", "score": 0.5}]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "conv_id long, record string")
    got = sorted((r.conv_id, r.turn if r.turn is not None else -1, r.text) for r in op10_chat.canonical_records(df).collect())
    assert got == [(0, 0, "p"), (0, 1, "c"), (1, 0, "u"), (1, 1, "a"), (2, -1, None), (3, 0, "i"), (3, 1, "o")]


def test_substring_stage_against_brute_force(spark, docs):
    """remove_repeats: exactly the words in windows that start in a smaller document go; other text stays as it is."""
    r = np.random.default_rng(4)
    shared = [[f"s{k}x{i}" for i in range(30)] for k in range(4)]
    texts = {}
    for i in range(60):
        w = []
        for k in r.integers(0, 5, 4):
            w += [f"d{i}y{j}" for j in range(r.integers(0, 5))] + (shared[k][r.integers(0, 10) :] if k < 4 else [])
        texts[i] = w
    first = {}
    for i, w in texts.items():
        for s in range(len(w) - 12):
            first.setdefault(tuple(w[s : s + 13]), i)
    want = {}
    for i, w in texts.items():
        gone = {p for s in range(len(w) - 12) if first[tuple(w[s : s + 13])] < i for p in range(s, s + 13)}
        want[i] = [x for p, x in enumerate(w) if p not in gone]
    df = clashing(spark.createDataFrame([(i, " ".join(w), len(" ".join(w))) for i, w in texts.items()], "doc_id long, text string, n_chars long")).repartition(3)
    got = {x.doc_id: x for x in op9_substrings.remove_repeats(df, 13).collect()}
    assert {i: x.text.split() for i, x in got.items() if x.text.split() or not texts[i]} == {i: w for i, w in want.items() if w or not texts[i]}
    assert all(x.n_chars == len(x.text) for x in got.values()) and op9_substrings.remove_repeats(docs.limit(0), 13).count() == 0
