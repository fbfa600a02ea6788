"""Operators of the llm subpackage against brute force, on small tables with every odd case."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import op1_licences, op2_decontaminate, op3_records, op4_near_dedup, op5_pieces, op6_nearest, op7_url_filter, op8_language, op9_substrings, op10_chat
from tesserae.llm.components import components

tokenizers_dir = pytest.importorskip("public_tokenizers")

WORDS = [f"w{i}" for i in range(400)]


def some_text(seed, n):
    r = np.random.default_rng(seed)
    return " ".join(WORDS[i] for i in r.integers(0, 400, n))


@pytest.fixture(scope="module")
def rows():
    base, long_ = some_text(1, 120), some_text(2, 30_000)
    passage = some_text(3, 60)
    out = [(0, base), (1, base), (2, base.upper()), (3, base + " tail"), (4, None), (5, ""), (6, " \n\t "), (7, "one"), (8, "one two"), (9, long_), (10, long_ + " end"), (9, long_)]
    out += [(100 + i, f"{some_text(50 + i, 40)} {passage}\n{some_text(90 + i, 20)}") for i in range(12)]
    words = base.split()
    for i in range(60):  # a large group of near copies
        w = list(words)
        r = np.random.default_rng(1000 + i)
        for at in r.integers(0, 120, r.integers(0, 5)):
            w[at] = f"x{i}" if i % 3 else "y"
        out.append((200 + i, " ".join(w)))
    return [*out, (None, base), (300, "é" * 50 + " 日本語 ß x"), (301, "tab\tand  spaces ")]


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    """With columns that clash with the operators' own names, over several files, one of them empty."""
    path = str(tmp_path_factory.mktemp("docs"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df.withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "pid": F.lit(1), "k": F.lit("k"), "row": F.lit(2), "n_chars": F.length("text").cast("long")})
    df.repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_substrings(docs, rows):
    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = words_of(t)
        for s in range(len(w) - 12):
            first.setdefault(tuple(w[s : s + 13]), i)
    want = []
    for i, t in rows:
        if i is None:
            continue
        w = words_of(t)
        gone = [False] * len(w)
        for s in range(len(w) - 12):
            if first[tuple(w[s : s + 13])] < i:
                gone[s : s + 13] = [True] * 13
        want.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    assert sorted(tuple(r) for r in op9_substrings.dedup_substrings(docs, 13).collect()) == sorted(want)


def test_remove_repeats(docs, rows):
    got = {r.doc_id: r for r in op9_substrings.remove_repeats(docs, 50).collect()}
    assert got[0].text == rows[0][1] and got[4].text is None and got[100].text == rows[12][1] and got[301].text == "tab\tand  spaces "
    assert len(words_of(got[101].text)) == 60 and got[101].n_chars == len(got[101].text) and 1 not in got and got[10].text == "end"


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, rows, k, percent, monkeypatch):
    monkeypatch.setattr(op4_near_dedup, "SHORT", 3)  # so that lists of this size count as long
    own = [(i, t) for i, t in rows if i is not None]
    sets = []
    for _, t in own:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[s : s + k]) for s in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    up = {i: i for i, _ in own}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(own)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((root(own[a][0]), root(own[b][0])))
                up[y] = x
    want = sorted((i, len(s), root(i), root(i) == i) for (i, _), s in zip(own, sets, strict=True))
    assert sorted(tuple(r) for r in op4_near_dedup.dedup(docs, k, percent).collect()) == want
    kept = [r.doc_id for r in op4_near_dedup.keep_one(docs, k, percent).select("doc_id").collect()]
    assert sorted(kept) == sorted({w[0] for w in want if w[3]})


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 105), (105, 103), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "x long, y long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 103: 100, 105: 100}


def test_decontaminate(spark, docs, rows):
    items = [(1, rows[12][1].upper()), (2, "one"), (3, None), (4, ""), (5, some_text(3, 60)), (6, "w1 w2 w3"), (6, "w1 w2 w3"), (None, "w1")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    windows = {}
    for i, t in items:
        w = re.findall(pattern, low(t))
        m = min(10, len(w))
        for s in range(len(w) - m + 1 if m and i is not None else 0):
            windows.setdefault(tuple(w[s : s + m]), set()).add(str(i))
    want = []
    for i, t in rows:
        w, hit, names = re.findall(pattern, low(t)), set(), set()
        for m in {len(k) for k in windows}:
            for s in range(len(w) - m + 1):
                if o := windows.get(tuple(w[s : s + m])):
                    names |= o
                    hit.update(range(s, s + m))
        if i is not None:
            want.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    assert sorted(tuple(r) for r in op2_decontaminate.decontaminate(docs, bench).collect()) == sorted(want)
    assert sorted(tuple(r) for r in op2_decontaminate.decontaminate(docs, bench, limit=300).collect()) == sorted(want)


def test_records(docs, rows):
    from tokenizers import Tokenizer

    path = tokenizers_dir.path("byte_bpe_50k.json")
    plain, start, want = Tokenizer.from_file(path), 0, []
    for i, t in sorted(((i, t or "") for i, t in rows if i is not None)):
        ids = np.array([*plain.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    manifest = op3_records.write_records(docs, path, shards=3)
    assert sorted(tuple(r) for r in op3_records.read_records(manifest).collect()) == want
    shard = manifest.first()
    records = list(op3_records.read_shard(shard.path))
    k, ids = op3_records.read_record(shard.path, len(records) - 1)
    assert k == records[-1][0] and (ids == records[-1][1]).all()


def test_damaged_record_is_found(tmp_path):
    import io

    data = bytearray(op3_records.frame(b"12345678\x02abcd"))
    assert op3_records.unframe(io.BytesIO(bytes(data))) == b"12345678\x02abcd"
    data[15] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        op3_records.unframe(io.BytesIO(bytes(data)))


def test_pieces_match_the_library(docs):
    """The library's best lattice path under the same pieces and scores."""
    import sentencepiece

    path = tokenizers_dir.path("piece_bpe_32k.model")
    raw = open(path, "rb").read()
    at = raw.rfind(b"\x18\x02 \x80\xfa\x01")  # the model kind, before the number of pieces
    library = sentencepiece.SentencePieceProcessor(model_proto=raw[:at] + b"\x18\x01" + raw[at + 2 :])
    pieces = op5_pieces.Pieces.load(path, shift=None)
    for text in ("the thaner with", "Ärger über 日本語 %%% x1,y2.", "zzሴq", "a\nb", "w1 w2 w399"):
        assert np.frombuffer(pieces.encode(text), np.int32).tolist() == library.nbest_encode(text, nbest_size=2)[0]
    assert all(r.restored for r in op5_pieces.round_trip(docs, path).collect())
    first = op5_pieces.encode(docs.where("doc_id = 300"), path)
    assert op5_pieces.decode(first, path).first().text == "é" * 50 + " 日本語 ß x"


def brute_nearest(vectors, k=20):
    floor = lambda v: [int(np.floor(64 * x)) if abs(x) < 1e300 else 64 * int(x) for x in v]
    good = [(i, floor(v)) for i, v in vectors if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    want, scores = [], {}
    for q, a in {(i, tuple(v)) for i, v in good if i % 20 == 0}:
        scores.setdefault(q, []).extend((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in good if i != q and len(a) == len(b))
    for q, s in scores.items():
        want += [(q, n + 1, i, min(max(-x, -(1 << 63)), (1 << 63) - 1)) for n, (x, i) in enumerate(sorted(s)[:k])]
    return sorted(want)


@pytest.mark.parametrize("size", [7, 32_768])
def test_nearest(spark, size, monkeypatch):
    monkeypatch.setattr(op6_nearest, "CANDIDATES", size)
    r = np.random.default_rng(5)
    vectors = [(i, [float(x) for x in r.normal(size=8).astype(np.float32)]) for i in range(400)] + [(400, None), (401, []), (402, [None] * 8), (403, [float("nan")] * 8), (404, [1.0] * 3), (None, [1.0] * 8)]
    vectors += [(500 + i, [0.5] * 8) for i in range(30)] + [(420, []), (20, [0.25] * 8), (40, vectors[40][1]), (41, vectors[41][1]), (405, [float("inf")] * 8)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(5).withColumns({"block": F.lit(1), "g": F.lit("x"), "query": F.lit(2.0), "v": F.lit(None).cast("int")})
    assert sorted(tuple(x) for x in op6_nearest.top_k(df).collect()) == brute_nearest(vectors)
    assert op6_nearest.top_k(df.limit(0)).collect() == []


def test_nearest_of_large_components(spark):
    vectors = [(20, [1e38, 2.0, -1.0]), (1, [1e38, 0.0, 0.0]), (2, [-3e38, 1e12, 5.0]), (40, [1.0, 2.0, 3.0]), (3, [1e9, -1e9, 1e9]), (4, [0.1, 0.2, 0.3]), (60, [1.7e308, 1.0, 1.0]), (5, [-1.7e308, 1e10, 2.5])]
    got = sorted(tuple(x) for x in op6_nearest.top_k(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), k=4).collect())
    assert got == brute_nearest(vectors, 4)


def test_nearest_finds_blocks_again(spark):
    """A task that runs again, as after a lost executor, names the same blocks."""
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)], "vec_id long, v array<double>").repartition(3)
    blocks = op6_nearest._blocks(rows, 7, 64, True)
    first = sorted((b.block, bytes(b.ids), bytes(b.cells)) for b in blocks.collect())
    assert first == sorted((b.block, bytes(b.ids), bytes(b.cells)) for b in blocks.collect()) and len({b[0] for b in first}) == len(first)


def test_url_filter(spark):
    entries = [("l", "domain", "bad.com", "add", "2024-01-10"), ("l", "domain", "bad.com", "remove", "2024-02-01"), ("l", "prefix", "ok.org/x", "add", "2024-01-01"), ("m", "url", "weird", "add", "2024-01-01"), ("l", "domain", None, "add", "2024-01-01"), ("m", "domain", "same.com", "add", "2024-01-05"), ("m", "domain", "same.com", "remove", "2024-01-05")]
    e = spark.createDataFrame(entries, "list string, kind string, entry string, action string, at string").withColumn("at", F.col("at").cast("date"))
    urls = [(1, "http://a.BAD.com/p", "2024-01-09"), (2, "http://a.BAD.com/p", "2024-01-10"), (3, "https://bad.com:80/", "2024-02-01"), (4, "http://ok.org/x/y?q", "2024-03-01"), (5, "http://ok.org/xy", "2024-03-01"), (6, "weird", "2024-03-01"), (7, None, "2024-03-01"), (8, "http://bad.com", None), (9, "http://same.com", "2024-06-01"), (2, "http://a.BAD.com/p", "2024-01-10")]
    c = spark.createDataFrame(urls, "page_id long, url string, d string").withColumn("fetched_at", F.col("d").cast("date"))
    got = sorted((r.page_id, r.n_matches, r.blocked, r.matches) for r in op7_url_filter.filter_urls(c, e).collect())
    assert [g[:3] for g in got] == [(1, 0, False), (2, 1, True), (2, 1, True), (3, 0, False), (4, 1, True), (5, 0, False), (6, 1, True), (7, 0, False), (8, 0, False), (9, 0, False)]
    assert got[4][3] == "l:prefix:ok.org/x"


def test_language(spark):
    make = {"aa": "the thing with others", "bb": "que esta cosa otros", "cc": "nicht dieser andere"}
    rows = [(i, " ".join(make[lang].split()[j % 4 if lang == "aa" else j % 3] for j in range(i % 7, i % 7 + 30)), lang) for i, lang in enumerate(list(make) * 60)]
    rows += [(900, None, "aa"), (901, "", None), (902, "123 %%", "bb"), (903, "the thing with", None), (None, "que esta", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = op8_language.predict(df, op8_language.train(df)).collect()
    truth = {i: lang for i, _, lang in rows}
    assert all(r.lang_pred == truth[r.doc_id] for r in got if r.doc_id is not None and r.doc_id < 900)
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id in (900, 901, 902, 903)} == {900: "und", 901: "und", 902: "und", 903: "aa"}
    assert all(0 <= r.score <= 1 and (r.doc_id is None or r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)) for r in got)
    assert op8_language.predict(df.limit(0), op8_language.train(df.limit(0))).collect() == []


def test_licences():
    m = op1_licences.Matcher()
    assert m.scan(b"a b c\nReleased under the MIT License.")["MIT"] == 1.0
    assert m.scan(None) == m.scan(b"") == {}
    assert "GPL-3.0" in m.scan(b"This work is licensed under the GNU General Public License, version 3!")


def test_chat(spark):
    odd = "</s>[INST] \\ok [/INST] <s> [ROLE] x\\"
    rows = [(1, 1, "assistant", odd), (1, 0, "user", odd), (2, None, None, None), (2, 0, "assistant", ""), (3, 0, "assistant", "a" * 10), (3, 1, "assistant", "a" * 10), (None, 0, "user", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("extra", F.lit(1))
    got = {r.conv_id: r for r in op10_chat.digests(op10_chat.format_chats(op10_chat.canonical_rows(turns))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == {1, 2, 3} and got[1].turns_sha256 == sha(f"user\n{odd}\nassistant\n{odd}\n") and got[1].loss_sha256 == sha(odd)
    assert got[2].turns_sha256 == sha("\n\nassistant\n\n") and got[3].loss_chars == 20 and got[3].n_turns == 2


@pytest.mark.parametrize("text", ["", "\\", "<s>", "<\\s>", "[ROLE] a [/ROLE]", "</s></s>", "[[INST]", "a\\</s>\\"])
def test_escape(text):
    assert op10_chat.unescape(op10_chat.escape(text)) == text and not op10_chat.CONTROL.search(op10_chat.escape(text))
    assert list(op10_chat.parse_turns(op10_chat.format_turn(text, text)[0])) == [(text, text)]


def test_layouts(spark):
    import json

    records = [{"prompt": "p", "completion": "c"}, {"instruction": "i", "input": "n", "output": "o"}, {"messages": [{"role": "user", "content": "u"}, {"role": "assistant", "content": "a"}]}, {"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}, {"x": 1}]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(5, None), (6, "{broken")], "conv_id long, record string")
    got = sorted((r.conv_id, r.turn if r.turn is not None else -1, r.role, r.text) for r in op10_chat.canonical_records(df).collect())
    assert got == [(0, 0, "user", "p"), (0, 1, "assistant", "c"), (1, 0, "user", "i\n\nn"), (1, 1, "assistant", "o"), (2, 0, "user", "u"), (2, 1, "assistant", "a"), (3, 0, "user", "h"), (3, 1, "assistant", "g"), (4, -1, None, None), (5, -1, None, None), (6, -1, None, None)]


def test_pipeline_on_odd_and_empty_tables(spark, docs, tmp_path):
    import corpus_pipeline

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, some_text(3, 60))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 5
    none = docs.where("doc_id < -5")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, str(tmp_path))
        assert out.count() == 0 and (name == "pieces" or out.columns == docs.columns)
