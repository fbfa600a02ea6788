"""Corpus operators do the whole job: inputs that an earlier, narrower version lost."""

import math
import zlib
from collections import Counter

import numpy as np

from tesserae.llm import op1_licences, op4_near_dedup, op8_language

APACHE = b"""Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""


def test_licences_with_other_bounds():
    m, long_ = op1_licences.Matcher(), b" ".join(b"w%d" % i for i in range(500))
    assert m.scan(long_ + b"\n" + APACHE + long_)["Apache-2.0"] == 1.0
    bsd = op1_licences.TEMPLATES[2][1].encode().replace(b" 1. ", b"\n\n1. ").replace(b" 2. ", b"\n\n2. ")
    assert m.scan(long_ + b"\n\n" + bsd + b"\n\n" + long_) == {"BSD-2-Clause": 1.0}
    assert m.scan(b"This project, which we started in 2019, is Released under the MIT License. See the site for more.") == {"MIT": 1.0}


def test_licences_are_those_of_all_runs():
    r, alphabet = np.random.default_rng(5), [b"a", b"b", b"c", b"d"]
    for _ in range(400):
        draw = lambda n: [alphabet[i] for i in r.integers(0, 4, n)]
        template, words = b" ".join(draw(r.integers(2, 9))), draw(r.integers(0, 25))
        grams = op1_licences.bigrams(template.split())
        best = 0.0
        for i in range(len(words)):
            for j in range(i + 2, len(words) + 1):
                own = op1_licences.bigrams(words[i:j])
                best = max(best, 2 * len(own & grams) / (len(own) + len(grams)))
        want = {"t": best} if 100 * best >= 80 - 1e-9 else {}
        assert op1_licences.Matcher([("t", template.decode())]).scan(b"\n".join(words)) == want


def test_near_dedup_keeps_rows_by_their_texts(spark):
    words = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcdef"]
    rows = [(1, words[0]), (1, words[1]), (2, words[1] + " end"), (None, words[2]), (None, words[3]), (None, words[0]), (3, words[4]), (3, words[4]), (None, None), (None, ""), (4, words[5]), (None, words[5] + " x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(str, map(tuple, op4_near_dedup.keep_one(df).collect())))
    assert got == sorted(map(str, [(1, words[0]), (1, words[1]), (None, words[2]), (None, words[3]), (3, words[4]), (None, None), (None, ""), (4, words[5])]))


def test_language_stage_rejects_languages_not_learned(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    foreign = ["Il gatto dorme tutto il giorno sulla sedia vicino alla finestra e la sera esce per cercare qualcosa da mangiare nel giardino.", "O menino caminhou pela rua estreita até encontrar a casa antiga onde a sua avó morava com muitos gatos."]
    strange = spark.createDataFrame([(-1 - i, t, "en", "s", len(t)) for i, t in enumerate(foreign)], docs.schema)
    got = [r.doc_id for r in corpus_pipeline.language(spark, docs.unionByName(strange), "/root/testdata/sf0.01").select("doc_id").collect()]
    assert min(got) >= 0 and len(got) >= 0.998 * docs.count()
    assert {r.doc_id for r in op8_language.keep_known(strange, op8_language.train(docs)).collect()} == {-1, -2}


def language_rows():
    """9000 documents of two languages, each with words of its own and more or less of what its language never repeats."""
    r, rows = np.random.default_rng(3), []
    for i in range(9000):
        lang, letters = ("aa", "abcdefghij") if i % 9 else ("bb", "klmnopqrst")
        usual = [letters[j : j + 4] for j in range(6)]
        noise = ["".join("abcdefghijklmnopqrstuvwxyz"[c] for c in r.integers(0, 26, r.integers(2, 9))) for _ in range(r.integers(0, 30))]
        rows.append((i, " ".join(usual[c] for c in r.integers(0, 6, r.integers(8, 40))) + " " + " ".join(noise), lang))
    return rows


def test_language_learns_from_every_document(spark, monkeypatch):
    monkeypatch.setattr(op8_language, "CHUNK_BYTES", 10_000)
    monkeypatch.setattr(op8_language, "HELD", 1000)
    monkeypatch.setattr(op8_language, "PASSED", 300)
    rows, counts = language_rows(), {"aa": Counter(), "bb": Counter()}
    for i, text, lang in rows:
        if zlib.crc32(str(i).encode()) % 3 != 1:
            counts[lang].update(op8_language.codes(op8_language.plain(text.encode())).tolist())
    totals = {lang: found.total() for lang, found in counts.items()}
    rates = {lang: {g: c / totals[lang] for g, c in found.items()} for lang, found in counts.items()}
    most = {g: max(found.get(g, 0) for found in rates.values()) for found in rates.values() for g in found}
    features = {lang: np.array([g for g, c in found.items() if c > 1 and rates[lang][g] >= 0.25 * most[g]], np.uint32) for lang, found in counts.items()}
    want, got = op8_language.Model.build(features), op8_language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert got.languages == want.languages and got.bits == want.bits and (got.planes[0] == want.planes[0]).all()


def test_language_stage_asks_what_all_held_out_documents_have(spark, tmp_path):
    import corpus_pipeline

    rows = language_rows()
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = op8_language.train(docs)
    ranked, scores = {i: model.ranked(text.encode()) for i, text, _ in rows}, {"aa": [], "bb": []}
    for i, _, lang in rows:
        if zlib.crc32(str(i).encode()) % 3 == 1 and ranked[i][0] == lang:
            scores[lang].append(ranked[i][1])
    assert len(scores["aa"]) > 2000
    for below in (0.001, 0.01):
        want = {lang: 0.9 * sorted(found)[math.ceil(round(below * len(found), 6)) - 1] for lang, found in scores.items()}
        assert op8_language.least_scores(docs, model, below=below) == want
    own = op8_language.least_scores(docs, model)
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs, str(tmp_path)).select("doc_id").collect()}
    assert kept == {i for i, (lang, score, n) in ranked.items() if score >= max(0.1, own[lang] - n**-0.5)}


def test_quantiles_are_exact(spark):
    r = np.random.default_rng(4)
    near = 0.5 + r.integers(0, 900, 4000) * 2.0**-52  # apart in their last bits only
    scores = {"a": near, "b": r.random(3000), "c": np.repeat([0.0, 0.25, 1.0], 50), "d": np.array([0.7])}
    df = spark.createDataFrame([(lang, int(b)) for lang, found in scores.items() for b in found.view(np.int64)], "lang string, bits long")
    for below in (0.001, 0.3, 0.57, 1.0):
        want = {lang: int(np.sort(found)[max(1, math.ceil(round(below * len(found), 6))) - 1].view(np.int64)) for lang, found in scores.items()}
        assert op8_language._quantiles(df, below) == want
    assert op8_language._quantiles(df.limit(0), 0.001) == {}
