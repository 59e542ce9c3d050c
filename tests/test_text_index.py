"""The stored index against BM25 by its formula and against the scan of documents."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright.operators import search as S
from sievewright.operators import text_index as X


def corpus(rng, n):
    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(rng.choice(words[: rng.randint(1, 60)]) for _ in range(rng.randint(0, 40)))) for k in range(n)]
    return [*rows, (n + 1, None), (n + 2, ""), (n + 3, "漢字漢字 w1"), (-5, "w1 W1 w1"), (10**12, "w1 " * 300)]


def by_formula(queries, rows):
    docs = {d: Counter(S.words_of(t)) for d, t in rows}
    length = {d: max(1, sum(c.values())) for d, c in docs.items()}
    n, avg = len(docs), sum(length.values()) / len(docs)
    df = Counter(t for c in docs.values() for t in c)
    out = {}
    for q, text in queries:
        for d, tf in docs.items():
            held = [t for t in set(S.words_of(text)) if tf[t]]
            if held:
                out[q, d] = sum(max(math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1), 1e-9) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * length[d] / avg)) for t in held)
    return out


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    rows = corpus(random.Random(8), 700)
    path = str(tmp_path_factory.mktemp("docs") / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)
    docs = spark.read.parquet(path)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(X, "WINDOW", 16)
        patch.setattr(X, "SEGMENT_DOCS", 150)
        yield rows, docs, X.ensure(docs, str(tmp_path_factory.mktemp("index")))


QUERIES = [(1, "w1"), (2, "w59 w3 w7"), (3, " ".join(f"w{k}" for k in range(60))), (4, "nowhere"), (5, ""), (6, None), (7, "漢字 w1 w1")]


@pytest.mark.parametrize("k", [1, 3, 25, None])
def test_best_are_those_of_the_formula(spark, indexed, k):
    rows, docs, index = indexed
    queries = spark.createDataFrame(QUERIES, "query_id long, query string")
    found = X.bm25(queries, index, k)
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in (found if k is None else S.ranked(found, k)).collect()}
    want = by_formula(QUERIES, rows)
    if k is None:
        assert got == pytest.approx(want, abs=2e-6) and got.keys() == want.keys()
    for q, _ in QUERIES:
        best = sorted((-S.rounded(np.array([v]))[0], d) for (p, d), v in want.items() if p == q)[:k]
        mine = sorted((-v, d) for (p, d), v in got.items() if p == q)
        assert [v for v, _ in mine] == pytest.approx([v for v, _ in best], abs=2e-6)
    scan = {(r["query_id"], r["doc_id"]): r["score"] for r in S.ranked(S.bm25(queries, docs.select("doc_id", "text"), k), k).collect()}
    assert scan == pytest.approx(got, abs=2e-6)


def test_windows_below_the_best_stay_closed(indexed, monkeypatch):
    ids = list(range(4000))
    texts = ["alpha " * (30 if 500 <= k < 510 else 1) + "beta " * 30 for k in ids]
    monkeypatch.setattr(X, "OPENED", 1)
    segment, looked = X._Segment(X.segment("s", ids, texts).to_pylist(), 31.0), []
    real = np.searchsorted
    monkeypatch.setattr(X.np, "searchsorted", lambda a, v, *r, **k: (looked.append(len(v)), real(a, v, *r, **k))[1])
    found, scores = segment.best({"alpha": 2.0}, 5)
    assert list(found) == [500, 501, 502, 503, 504] and sum(looked) < segment.windows // 2


def test_changed_documents_are_indexed_anew(spark, tmp_path):
    where, folder = str(tmp_path / "docs"), str(tmp_path / "index")
    make = lambda text: spark.createDataFrame([(1, "one two"), (2, text)], "doc_id long, text string").coalesce(1).write.mode("overwrite").parquet(where)
    make("three")
    first = X.ensure(spark.read.parquet(where), folder)
    built = spark.read.parquet(f"{folder}/index/facts").inputFiles()
    assert X.ensure(spark.read.parquet(where), folder) == first and spark.read.parquet(f"{folder}/index/facts").inputFiles() == built
    make("three four")
    docs = spark.read.parquet(where)
    assert X.load(spark, f"{folder}/index", X.fingerprint(docs)) is None
    again = X.ensure(docs, folder)
    assert again.avg_len == 2.0 and {r["term"] for r in X.stats(again).collect()} == {"one", "two", "three", "four"}
    assert X.fingerprint(docs.filter("doc_id = 1")) != X.fingerprint(docs)
    assert X.load(spark, str(tmp_path / "nowhere"), "x") is None


def test_no_documents_and_no_queries(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    index = X.ensure(none, str(tmp_path))
    queries = spark.createDataFrame(QUERIES, "query_id long, query string")
    assert index.n == 0 and X.bm25(queries, index, 5).collect() == []
    assert X.bm25(queries.filter("query_id > 99"), index, 5).collect() == []


def test_searches_do_not_read_the_documents(spark, indexed):
    _, docs, index = indexed
    queries = spark.createDataFrame(QUERIES, "query_id long, query string")
    plan = X.bm25(queries, index, 5)
    assert not set(docs.inputFiles()) & set(plan.inputFiles()) and plan.inputFiles()


def test_queries_beyond_one_set_are_all_searched(spark, indexed, monkeypatch):
    _, docs, index = indexed
    monkeypatch.setattr(S, "MOST_QUERIES", 3)
    queries = spark.createDataFrame(QUERIES, "query_id long, query string").repartition(2)
    for found in (X.bm25(queries, index, 2), S.bm25(queries, docs, 2), S.overlap(queries, docs, 2)):
        assert {r["query_id"] for r in found.collect()} >= {1, 2, 3, 7}
    vectors = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(9)], "doc_id long, embedding array<float>")
    near = S.vector_topk(vectors.withColumnRenamed("doc_id", "query_id"), vectors, 1)
    assert near.count() == 9 and near.filter(F.col("query_id") == 5).first()["doc_id"] == 8


def test_groups_give_what_all_pairs_give(spark):
    rng = random.Random(12)
    rows = [(k, "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 30))), rng.choice(["x", "y", "z", "", None])) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string").repartition(4)
    queries = spark.createDataFrame([(k, "".join(rng.choice("abcd ") for _ in range(12))) for k in range(9)], "query_id long, query string")
    for filtered, least in ((False, 0.4), (True, 0.0)):
        slim = S.overlap_groups(queries, docs, None if filtered else 3, None if filtered else least)
        want = S.diversified(S.overlap(queries, docs, least=None if filtered else least), docs, 3, least, filtered)
        got = S.diversified(slim, docs, 3, least, filtered)
        columns = ["query_id", "doc_id", "score", "label", "rank"]
        assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
        assert filtered or slim.count() <= 4 * 9 * 6
