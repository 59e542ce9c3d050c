"""Retrieval: inverted index, BM25, n-gram overlap, exact vector search, fusion, gates and tiers.

Queries are (query_id, query), documents (doc_id, text, ...). Every ranking breaks ties by id.

The text arms (BM25, 2-gram overlap, gated) take a stated, bounded set of queries to all documents:
each task scores its documents where they lie, block of queries by block, as matrix products, and keeps
each query's best k. Documents are never shuffled, and what is shuffled is k rows a query and task.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.functions import text as T

K1, B = 1.5, 0.75
POOL = 50
BLOCK = 256  #: queries that are scored at a time
MOST_QUERIES = 4096  #: of one search; larger sets are searched one after the other


def ranked(scores: DataFrame, k: int | None = None, score: str = "score", by: str = "query_id", tie: str = "doc_id") -> DataFrame:
    """Adds ``rank`` within each query, at most k of them."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), F.asc(tie)))
    out = scores.withColumn("rank", place)
    return out if k is None else out.filter(F.col("rank") <= k)


def postings(docs: DataFrame) -> DataFrame:
    """(doc_id, term, tf)"""
    return docs.select("doc_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def doc_lengths(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.greatest(F.size(T.tokens(F.col("text"))), F.lit(1)).cast("long").alias("len"))


def collection(docs: DataFrame) -> DataFrame:
    """One row: n documents and their average length."""
    return doc_lengths(docs).agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"))


def idf(n: Column, df: Column) -> Column:
    return F.greatest(F.ln((n - df + 0.5) / (df + 0.5) + 1), F.lit(1e-9))


_RUN = re.compile(f"[{T.CJK}A-Za-z0-9]+")
PAIRS = "query_id long, doc_id long, score double"


def words_of(text: str | None) -> list[str]:
    """As `functions.text.tokens`, of one text inside a task."""
    out: list[str] = []
    for run in _RUN.findall(text or ""):
        if run.isascii():
            out.append(run.lower())
        elif len(run) > 1:
            out += [run[k : k + 2] for k in range(len(run) - 1)]
        else:
            out.append(run)
    return out


def stated_sets(queries: DataFrame, columns: tuple[str, ...] = ("query_id", "query")) -> Iterator[list[tuple]]:
    """The queries in sets of MOST_QUERIES, each in order of ids. One set at a time goes to every task,
    however many queries there are."""
    held: list[tuple] = []
    for row in queries.select(*columns).toLocalIterator():
        held.append((row[0], row[1] if row[1] is not None else ""))
        if len(held) == MOST_QUERIES:
            yield sorted(held, key=lambda r: r[0])
            held = []
    if held:
        yield sorted(held, key=lambda r: r[0])


def over_sets(queries: DataFrame, search: Callable[[list[tuple]], DataFrame], columns: tuple[str, ...] = ("query_id", "query"), schema: str | None = None) -> DataFrame:
    """The rows of ``search`` over all sets of the queries, one after the other."""
    found = None
    for asked in stated_sets(queries, columns):
        found = search(asked) if found is None else found.unionByName(search(asked))
    return found if found is not None else queries.sparkSession.createDataFrame([], schema or PAIRS)


def rounded(x: np.ndarray) -> np.ndarray:
    """To six places, halves up."""
    return np.floor(x * 1e6 + 0.5) / 1e6


class Best:
    """Each query's best k (score, id) so far, ties by id."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.score, self.id = k, np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        """``scores`` has a row for each document; -inf is no hit. Only queries for which one is as good as
        their k-th best so far are looked at."""
        good = (scores.T >= self.score[:, -1:]) & (scores.T > -np.inf)
        for q in np.flatnonzero(good.any(axis=1)):
            at = np.flatnonzero(good[q])
            score, names = np.concatenate([self.score[q], scores[at, q]]), np.concatenate([self.id[q], ids[at]])
            some = np.flatnonzero(score >= np.partition(score, len(score) - self.k)[len(score) - self.k])
            order = some[np.lexsort((names[some], -score[some]))[: self.k]]
            self.score[q], self.id[q] = score[order], names[order]

    def rows(self, names: np.ndarray) -> pa.RecordBatch:
        q, at = np.nonzero(self.score > -np.inf)
        return pa.RecordBatch.from_arrays([pa.array(names[q]), pa.array(self.id[q, at]), pa.array(self.score[q, at])], names=["query_id", "doc_id", "score"])


def _hits(names: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    d, q = np.nonzero(scores > -np.inf)
    return pa.RecordBatch.from_arrays([pa.array(names[q]), pa.array(ids[d]), pa.array(scores[d, q])], names=["query_id", "doc_id", "score"])


def scored(docs: DataFrame, names: list[int], prepare: Callable[[], list], score: Callable, k: int | None, least: float | None = None) -> DataFrame:
    """(query_id, doc_id, score): ``prepare`` makes the blocks of queries in a task, ``score`` the
    scores of some texts by a block (-inf: no hit). Each task gives each query's best k, or all hits
    (at or above ``least``) where k is None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, ids_of = prepare(), np.asarray(names, np.int64)
        best = [Best(min(BLOCK, len(names) - at), k) for at in range(0, len(names), BLOCK)] if k else []
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                ids, texts = np.asarray(part.column(0), np.int64), part.column(1).to_pylist()
                for b, block in enumerate(blocks):
                    found = score(block, texts)
                    if k:
                        best[b].add(ids, found)
                        continue
                    if least is not None:
                        found = np.where(found >= least, found, -np.inf)
                    yield _hits(ids_of[b * BLOCK : b * BLOCK + BLOCK], ids, found)
        for b, one in enumerate(best):
            yield one.rows(ids_of[b * BLOCK : b * BLOCK + BLOCK])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PAIRS)


def frequencies(docs: DataFrame, terms: list[str]) -> tuple[int, float, dict[str, int]]:
    """Number of documents, their average length, and how many have each of the terms: one pass in
    which each task gives a partial count for each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, df = set(terms), dict.fromkeys(terms, 0)
        n = length = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                said = words_of(text)
                n, length = n + 1, length + max(1, len(said))
                for t in known.intersection(said):
                    df[t] += 1
        facts = [(t, c) for t, c in df.items() if c] + [("\0n", n), ("\0length", length)]
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in facts]), pa.array([c for _, c in facts], pa.int64())], names=["term", "c"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "term string, c long").groupBy("term").agg(F.sum("c").alias("c")).collect()  # a row a query term
    found = {r["term"]: r["c"] for r in rows}
    n, length = found.pop("\0n", 0), found.pop("\0length", 0)
    return n, length / max(1, n), found


def bm25(queries: DataFrame, docs: DataFrame, k: int | None = None) -> DataFrame:
    """(query_id, doc_id, score) of the pairs that share a term, or, with ``k``, of at least each
    query's best k. A first pass counts the documents of each query term."""
    return over_sets(queries, lambda asked: _bm25([(q, sorted(set(words_of(text)))) for q, text in asked], docs, k))


def _bm25(asked: list[tuple[int, list[str]]], docs: DataFrame, k: int | None) -> DataFrame:
    n, avg_len, df = frequencies(docs, sorted({t for _, ts in asked for t in ts}))
    idf_of = {t: max(np.log((n - d + 0.5) / (d + 0.5) + 1), 1e-9) for t, d in df.items()}
    sent = docs.sparkSession.sparkContext.broadcast((asked, idf_of, avg_len))  # bounded by MOST_QUERIES

    def prepare() -> list:
        asked, weight, avg = sent.value
        blocks = []
        for at in range(0, len(asked), BLOCK):
            part = asked[at : at + BLOCK]
            place = {t: i for i, t in enumerate(sorted({t for _, ts in part for t in ts if t in weight}))}
            matrix = np.zeros((len(place), len(part)))
            for q, (_, ts) in enumerate(part):
                for t in ts:
                    if t in place:
                        matrix[place[t], q] = weight[t]
            blocks.append((place, matrix, avg))
        return blocks

    def score(block: tuple, texts: list) -> np.ndarray:
        place, matrix, avg = block
        tf, length = np.zeros((len(texts), len(place))), np.ones(len(texts))
        for d, text in enumerate(texts):
            said = words_of(text)
            length[d] = max(1, len(said))
            at = [i for i in map(place.get, said) if i is not None]
            tf[d] = np.bincount(np.asarray(at, np.int64), minlength=len(place)) if at else 0
        total = (tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[:, None] / avg))) @ matrix
        return np.where(total > 0, rounded(total), -np.inf)

    return scored(docs, [q for q, _ in asked], prepare, score, k)


def bm25_stats(docs: DataFrame) -> DataFrame:
    """(term, df, idf) over all documents."""
    df = postings(docs).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(collection(docs))).select("term", "df", F.round(idf(F.col("n"), F.col("df")), 6).alias("idf"))


def grams_of(text: str | None) -> np.ndarray:
    """Distinct character 2-grams of a text, as numbers in order."""
    codes = np.frombuffer((text or "").encode("utf-32-le"), "<u4").astype(np.int64)
    return np.unique((codes[:-1] << 21) | codes[1:])


def _gram_blocks(asked: list[tuple[int, str]]) -> list:
    blocks = []
    for at in range(0, len(asked), BLOCK):
        grams = [grams_of(text) for _, text in asked[at : at + BLOCK]]
        known = np.unique(np.concatenate(grams))
        matrix = np.zeros((len(known), len(grams)), np.float32)
        for q, g in enumerate(grams):
            matrix[np.searchsorted(known, g), q] = 1
        blocks.append((known, matrix, np.array([max(1, len(g)) for g in grams], float)))
    return blocks


def _overlaps(block: tuple, texts: list) -> np.ndarray:
    """Rounded shares of the queries' grams that each text has; -inf where it has none."""
    known, matrix, sizes = block
    held = np.zeros((len(texts), len(known)), np.float32)
    for d, text in enumerate(texts):
        found = grams_of(text)
        at = np.searchsorted(known, found)
        at, found = at[at < len(known)], found[at < len(known)]
        held[d, at[known[at] == found]] = 1
    shared = (held @ matrix).astype(float)
    return np.where(shared > 0, rounded(shared / sizes), -np.inf)


def overlap(queries: DataFrame, docs: DataFrame, k: int | None = None, least: float | None = None) -> DataFrame:
    """(query_id, doc_id, score): the share of the query's 2-grams that the document has, of pairs
    that share one (at or above ``least``), or, with ``k``, of at least each query's best k."""

    def one(asked: list[tuple]) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(asked)  # bounded by MOST_QUERIES
        return scored(docs, [q for q, _ in asked], lambda: _gram_blocks(sent.value), _overlaps, k, least)

    return over_sets(queries, one)


def overlap_groups(queries: DataFrame, docs: DataFrame, k: int | None = None, least: float | None = None) -> DataFrame:
    """(query_id, doc_id, score) of overlap, of (doc_id, text, label): from each task the best document of each
    query and label, and of documents without a label, each its own group, the best ``k`` (all where it is
    None). No task gives more rows than it has labels and queries, but for those."""

    def one(asked: list[tuple]) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(asked)  # bounded by MOST_QUERIES

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, blocks = np.array([q for q, _ in sent.value], np.int64), _gram_blocks(sent.value)
            best: dict[str, Best] = {}
            for batch in batches:
                for start in range(0, batch.num_rows, 512):
                    part = batch.slice(start, 512)
                    ids, texts = np.asarray(part.column(0), np.int64), part.column(1).to_pylist()
                    score = np.concatenate([_overlaps(block, texts) for block in blocks], axis=1)
                    if least is not None:
                        score = np.where(score >= least, score, -np.inf)
                    rows: dict[str, list[int]] = {}
                    for d, label in enumerate(part.column(2).to_pylist()):
                        rows.setdefault(label or "", []).append(d)
                    for label, at in rows.items():
                        if not label and k is None:
                            yield _hits(names, ids[at], score[at])
                            continue
                        if label not in best:
                            best[label] = Best(len(names), 1 if label else k)
                        best[label].add(ids[at], score[at])
            for held in best.values():
                yield held.rows(names)

        return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("label").cast("string")).mapInArrow(run, PAIRS)

    return over_sets(queries, one)


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank) of the k largest dot products of stated sets of queries with all
    vectors. A set goes to every task, which passes over its vectors once and keeps each query's best k."""

    def one(asked: list[tuple]) -> DataFrame:
        names = np.array([q for q, _ in asked], np.int64)
        sent = vectors.sparkSession.sparkContext.broadcast(np.array([list(v) for _, v in asked], np.float64))  # bounded by MOST_QUERIES

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(len(names), k)
            for batch in batches:
                for start in range(0, batch.num_rows, 2048):
                    part = batch.slice(start, 2048)
                    matrix = np.asarray(part.column(1).flatten(), np.float64).reshape(part.num_rows, -1)
                    best.add(np.asarray(part.column(0), np.int64), np.round(matrix @ sent.value.T, 6))
            yield best.rows(names)

        return vectors.filter("embedding is not null").select(F.col("doc_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, PAIRS)

    return ranked(over_sets(queries.filter("embedding is not null"), one, ("query_id", "embedding")), k)


def rrf(arms: list[tuple[DataFrame, float]], k: int = 60, pool: int | None = POOL, shown: bool = True) -> DataFrame:
    """Reciprocal rank fusion of (query_id, doc_id, rank) arms; ``display`` falls from 1 by place."""
    parts = None
    for arm, weight in arms:
        held = arm if pool is None else arm.filter(F.col("rank") <= pool)
        one = held.select("query_id", "doc_id", (F.lit(float(weight)) / (k + F.col("rank"))).alias("part"))
        parts = one if parts is None else parts.unionByName(one)
    fused = ranked(parts.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 9).alias("score")))
    if not shown:
        return fused
    return fused.withColumn("display", F.round(1 - (F.col("rank") - 1) / F.count(F.lit(1)).over(Window.partitionBy("query_id")), 6))


def max_normalised(scores: DataFrame) -> DataFrame:
    return scores.withColumn("normalised", F.round(F.col("score") / F.max("score").over(Window.partitionBy("query_id")), 6))


def gated(queries: DataFrame, docs: DataFrame, tactic: list[str], distress: list[str], k: int, bonus: float = 0.15, narrow: int = 4) -> DataFrame:
    """Search for queries with a tactic or distress term only. Documents that share a tactic term
    with the query are searched alone where there are at least ``narrow * k`` of them; each shared
    term's part of the bonus is added; scores of 0 are dropped after the cut.

    Each task gives the best k of both pools and how many of its documents are in the narrow one; the
    sum of these counts decides which pool a query's hits come from."""
    tactic = [t for t in tactic if t]
    gate = queries.filter((F.size(T.hits(F.col("query"), tactic)) > 0) | T.any_term(F.col("query"), distress))
    return over_sets(gate, lambda asked: _gated(asked, docs, tactic, k, bonus, narrow), schema=PAIRS + ", rank int")


def _gated(asked: list[tuple], docs: DataFrame, tactic: list[str], k: int, bonus: float, narrow: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(asked)  # bounded by MOST_QUERIES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([q for q, _ in sent.value], np.int64)
        said = np.array([[t in text for t in tactic] for _, text in sent.value], float).reshape(len(names), len(tactic))
        blocks = _gram_blocks(sent.value)
        pools = [(Best(len(names), k), Best(len(names), k))] if len(names) else []
        counts = np.zeros(len(names), np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows if len(names) else 0, 512):
                part = batch.slice(start, 512)
                ids, texts = np.asarray(part.column(0), np.int64), part.column(1).to_pylist()
                base = np.concatenate([_overlaps(block, texts) for block in blocks], axis=1)
                held = np.array([[t in (text or "") for t in tactic] for text in texts], float).reshape(len(texts), len(tactic))
                shared = held @ said.T
                score = np.where(base > -np.inf, rounded(np.minimum(1.0, base + bonus * shared / np.maximum(1, said.sum(axis=1)))), -np.inf)
                inside = (shared > 0) & (base > -np.inf)
                counts += inside.sum(axis=0)
                pools[0][0].add(ids, score)
                pools[0][1].add(ids, np.where(inside, score, -np.inf))
        for wide, slim in pools:
            for pool, best in enumerate((wide, slim)):
                rows = best.rows(names)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([pool] * rows.num_rows, pa.int32()), pa.array([0] * rows.num_rows, pa.int64())], names=["query_id", "doc_id", "score", "pool", "n"])
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([None] * len(names), pa.int64()), pa.array([None] * len(names), pa.float64()), pa.array([None] * len(names), pa.int32()), pa.array(counts)], names=["query_id", "doc_id", "score", "pool", "n"])

    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PAIRS + ", pool int, n long")
    total = F.sum("n").over(Window.partitionBy("query_id"))
    chosen = found.withColumn("total", total).filter(F.col("pool") == F.when(F.col("total") >= narrow * k, 1).otherwise(0))
    return ranked(chosen.select("query_id", "doc_id", "score"), k).filter("score > 0").select("query_id", "doc_id", "score", "rank")


def diversified(scores: DataFrame, docs: DataFrame, k: int, least: float, filtered: bool = False) -> DataFrame:
    """The best document of each label at or above a threshold (none where facets filter); k grows
    to the number of labels where facets filter."""
    named = scores.filter(F.lit(True) if filtered else F.col("score") >= least).join(docs.select("doc_id", "label"), "doc_id")
    group = F.coalesce(F.nullif(F.col("label"), F.lit("")), F.col("doc_id").cast("string"))
    best = F.row_number().over(Window.partitionBy("query_id", group).orderBy(F.desc("score"), "doc_id"))
    one = ranked(named.withColumn("best", best).filter("best = 1").drop("best"))
    if filtered:
        wide = named.groupBy("query_id").agg(F.greatest(F.lit(k), F.count_distinct(group)).alias("k"))
        return one.join(wide, "query_id").filter("rank <= k").drop("k")
    return one.filter(F.col("rank") <= k)


def tiered(tiers: list[DataFrame]) -> DataFrame:
    """Per query the rows of the first tier that has any, with the tier and whether it degraded."""
    parts = None
    for place, tier in enumerate(tiers):
        one = tier.withColumn("tier", F.lit(place))
        parts = one if parts is None else parts.unionByName(one)
    return parts.withColumn("__first", F.min("tier").over(Window.partitionBy("query_id"))).filter("tier = __first").drop("__first").withColumn("degraded", F.col("tier") > 0)


def pool_scores(pool: DataFrame, scores: DataFrame, default: float = 0.0) -> DataFrame:
    """Adds ``other``, the second arm's score of each pair of the pool, or the default."""
    return pool.join(scores.select("query_id", "doc_id", F.col("score").alias("other")), ["query_id", "doc_id"], "left").fillna({"other": default})


def judged_or_gold(judged: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, doc_id, judged): the judged pairs, and for queries without any the gold pairs."""
    found = judged.select("query_id", "doc_id").distinct()
    rest = gold.select("query_id", "doc_id").distinct().join(found.select("query_id").distinct(), "query_id", "left_anti")
    return found.withColumn("judged", F.lit(True)).unionByName(rest.withColumn("judged", F.lit(False)))
