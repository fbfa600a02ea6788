"""Queries do the whole job: inputs that an earlier, narrower version lost."""

import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import agent, curation, retrieval


@pytest.mark.parametrize("limit", [1 << 20, 20])
def test_contained_items(spark, limit):
    items = [(1, "one two\nthree four five six"), (2, "short item"), (3, "a b c d"), (4, "x"), (5, "a  b\n\nc d"), (6, None), (7, "one two three four five six"), (8, "w1 w2 w3 w4 w5"), (9, "")]
    docs = [(1, "zone two\nthree four five sixth"), (2, "a short items"), (3, "aa b c dd"), (4, None), (5, ""), (6, "za  b\n\nc de"), (7, "one two three four five six\nx"), (8, "0w1 w2 w3 w4 w55"), (8, "w1 w2 w3 w4"), (None, "w1 w2 w3 w4 w5")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(str, map(tuple, curation.contained_items(d, b, limit).collect())))
    assert got == sorted(str((i, k)) for i, t in docs for k, x in items if t is not None and x is not None and x in t)


def near(x, y):
    short = min(len(x), len(y))
    return bool(short) and (x == y or (short >= 3 and (x in y or y in x)) or (short >= 4 and difflib.SequenceMatcher(None, x, y).ratio() >= 0.88))


def test_near_classes_are_those_of_all_pairs(spark):
    r = random.Random(3)
    names = ["".join(r.choice("abc ") for _ in range(r.randint(0, 7))) for _ in range(60)]
    for _ in range(300):  # edits of long names, next to each other or not
        base = list(r.choice([n for n in names if len(n) > 3] + ["a rather long name of a part", "é" * 3 + "xyz", "aaaaaaaaaaaaaaaaaaaaaaaaaa"]))
        for _ in range(r.randint(0, 4)):
            at = r.randrange(len(base))
            base[at : at + r.randint(0, 1)] = r.choice(["", "q", "zz", "a"])
        names.append("".join(base))
    names += ["b" * 230, "b" * 210 + "c" * 20, "zebra", None, None, "zebra"]
    df = spark.createDataFrame(list(enumerate(names)), "k long, a string").repartition(3)
    distinct = {}
    for k, a in enumerate(names):
        if a:
            distinct.setdefault(a, k)
    order = sorted(distinct.items(), key=lambda x: x[1])
    links = {(i, j) for n, (a, i) in enumerate(order) for b, j in order[n + 1 :] if near(a, b)}
    found = {(p.x, p.y) for p in curation.near_candidates(df.where("a <> ''").groupBy("a").agg(F.min("k").alias("k"))).collect()}
    assert len(links) > 100 and links <= found
    root = {k: k for k in distinct.values()}
    while any(root[i] != root[j] for i, j in links):
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
    got = {p.k: (p.name_class, p.class_id) for p in curation.near_classes(df, "k", "a").collect()}
    assert got == {k: (distinct[a], root[distinct[a]]) if a else (k, k) for k, a in enumerate(names)}


@pytest.mark.parametrize("groups", [1, 3])
def test_nearest_of_every_query(spark, groups):
    r = np.random.default_rng(4)
    rows = [(i, r.integers(-2, 3, 3).astype(float).tolist()) for i in range(205)] + [(300, [0.0, 0.0, 0.0]), (350, None), (400, [1.0, None, 2.0]), (None, [1.0, 2.0, 3.0])]
    got = retrieval.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4), groups=groups).collect()
    unit = {i: np.array(v) / (np.linalg.norm(v) or 1) for i, v in rows if i is not None and v and None not in v}
    want = set()
    for q in (0, 50, 100, 150, 200, 300):
        best = sorted((-round(float(unit[q] @ v), 6), i) for i, v in unit.items() if i != q)[:5]
        want |= {(q, i, -s + 0.0, n + 1) for n, (s, i) in enumerate(best)}
    assert {(x.query_id, x.vec_id, x.score + 0.0, x.rnk) for x in got} == want and len(got) == len(want)


def test_observations_show_the_passage_asked_for(spark):
    filler, late = "filler words without sense " * 40, "etching rate is 42 nm a minute"
    texts = {1: f"{filler}\n{late} {filler}", 2: late, 3: f"{filler}etching"}
    chunk = spark.createDataFrame([(i, f"s{i}", "", t) for i, t in texts.items()], "chunk_id long, source string, heading string, text string")
    asked = spark.createDataFrame([(7, "etching rate"), (8, "nothing alike")], "query_id long, query string")

    def passage(text, limit=520):
        flat = " ".join(text.split())
        if len(flat) <= limit:
            return flat
        at = min(p for p in (flat.lower().find(w) for w in ("etching", "rate")) if p >= 0)
        end = min(len(flat), max(0, at - limit // 3) + limit)
        start = max(0, end - limit)
        return ("…" if start else "") + flat[start:end].strip() + ("…" if end < len(flat) else "")

    ranked = retrieval.search(chunk, asked, 3).orderBy("rank").collect()
    want = "\n\n".join(["[检索结果]"] + [f"{r['rank']}. 来源：{r.source}\n相关度：{r.raw_score:.2f}\n{passage(texts[r.chunk_id])}" for r in ranked])[:1800]
    got = agent.observed(chunk, asked).collect()
    assert [tuple(r) for r in got] == [(7, want)] and len(ranked) == 3 and want.count(late) == 2
