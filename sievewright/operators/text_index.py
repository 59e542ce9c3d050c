"""A stored inverted index over documents, and BM25 search that reads it in place of the documents.

The index is a table of posting lists, made in one pass and without a shuffle. Documents are dealt
into segments where they lie; a segment numbers its documents and keeps one row a term. A list is cut
into blocks by windows of ``WINDOW`` documents: numbers are kept as steps from one block's window to
the next and, within a block, as places in the window (which take a byte); beside each block stand the largest term
frequency and the shortest document in it, which bound the score that the term can give there. Beside
the lists are the terms' document frequencies, and facts of the collection with a fingerprint of what
the index was made from: another fingerprint is another index.

A search takes a stated set of queries. Lists of their terms meet by segment, so a document's score is
whole where its segment is, and k rows a query and segment are all that is shuffled on. Within a
segment, windows are scored in the order of their bounds, and those whose bound is below the k-th best
score are never opened.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.operators import search as S
from sievewright.session import checkpoint_dir

#: Documents of a window (places in it take a byte), and the text and documents at which a segment is closed.
WINDOW, SEGMENT_BYTES, SEGMENT_DOCS = 256, 8 << 20, 1 << 16
#: Windows that a query opens at a time.
OPENED = 4

LISTS = "segment string, term string, n int, steps binary, counts binary, most binary, least binary, places binary, tfs binary"
#: Part of every fingerprint: an index of another format is another index.
FORMAT = f"lists 2, windows of {WINDOW}: "
#: Numbers in each column of a list.
KINDS = {"steps": np.uint32, "counts": np.uint16, "most": np.uint32, "least": np.uint32, "places": np.uint8, "tfs": np.uint32}


def _unpacked(row: dict, column: str) -> np.ndarray:
    return np.frombuffer(row[column], KINDS[column]).astype(np.int64)


def _sliced(numbers: np.ndarray, bounds: np.ndarray, column: str) -> pa.BinaryArray:
    """A column's numbers, cut at ``bounds``."""
    kind = np.dtype(KINDS[column])
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * kind.itemsize).astype(np.int32)), pa.py_buffer(numbers.astype(kind))])


def segment(name: str, ids: list[int], texts: list[str | None]) -> pa.RecordBatch:
    """The rows of one segment: a posting list for each term, and its documents under the term null."""
    order = np.argsort(np.asarray(ids, np.int64), kind="stable")
    said = [S.words_of(texts[k]) for k in order]
    sizes = np.array([len(w) for w in said])
    coded = pa.array([w for ws in said for w in ws], pa.string()).dictionary_encode()
    keys, tfs = np.unique(np.asarray(coded.indices, np.int64) * len(ids) + np.repeat(np.arange(len(ids)), sizes), return_counts=True)
    code, number = keys // len(ids), keys % len(ids)
    lengths, window = np.maximum(1, sizes), number // WINDOW
    block = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(window, prepend=-1) != 0))
    term = np.flatnonzero(np.diff(code, prepend=-1))
    blocks = np.append(np.searchsorted(block, term), len(block))
    steps = np.diff(window[block], prepend=0)
    steps[blocks[:-1]] = window[block][blocks[:-1]]
    most, least = (f.reduceat(x, block) if len(block) else x for f, x in ((np.maximum, tfs), (np.minimum, lengths[number])))
    rows = np.append(term, len(number))
    columns = [_sliced(x, blocks, c) for x, c in ((steps, "steps"), (np.diff(np.append(block, len(number))), "counts"), (most, "most"), (least, "least"))]
    columns += [_sliced(number % WINDOW, rows, "places"), _sliced(tfs, rows, "tfs")]
    head = [[name], [None], [len(ids)], [b""], [b""], [b""], [b""], [np.asarray(ids, np.int64)[order].tobytes()], [lengths.astype(KINDS["tfs"]).tobytes()]]
    lists = [pa.array([name] * len(term), pa.string()), coded.dictionary.take(pa.array(code[term])), pa.array(np.diff(rows), pa.int32()), *columns]
    return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(h, c.type), c]) for h, c in zip(head, lists, strict=True)], [c.split()[0] for c in LISTS.split(", ")])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, texts, held = [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(doc)
            texts.append(text)
            held += len(text or "")
            if held >= SEGMENT_BYTES or len(ids) >= SEGMENT_DOCS:
                yield segment(uuid.uuid4().hex, ids, texts)
                ids, texts, held = [], [], 0
    if ids:
        yield segment(uuid.uuid4().hex, ids, texts)


def fingerprint(docs: DataFrame) -> str:
    """Of what a frame reads: the index's format, its plan, and the names, sizes and times of its files. A frame that reads no
    files is known by its rows."""
    spark = docs.sparkSession
    folders: dict[str, set[str]] = {}
    for name in docs.inputFiles():
        folder, _, _ = name.rpartition("/")
        folders.setdefault(folder, set()).add(name)
    if not folders:
        from sievewright.operators.dense import fingerprint as of_rows

        return hashlib.sha256((FORMAT + of_rows(docs)).encode()).hexdigest()
    facts = [FORMAT + docs._jdf.queryExecution().optimizedPlan().canonicalized().toString()]
    for folder, names in sorted(folders.items()):
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        for status in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path):
            if any(n.endswith("/" + status.getPath().getName()) for n in names):
                facts.append(f"{folder}/{status.getPath().getName()} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join([facts[0], *sorted(facts[1:])]).encode()).hexdigest()


@dataclass(frozen=True)
class Index:
    """A committed index: where it is, how many documents it has and their average length."""

    spark: SparkSession
    path: str
    n: int
    avg_len: float

    @property
    def lists(self) -> DataFrame:
        return self.spark.read.schema(LISTS).parquet(f"{self.path}/lists")

    @property
    def terms(self) -> DataFrame:
        """(term, df)"""
        return self.spark.read.schema("term string, df long").parquet(f"{self.path}/terms")


def build(docs: DataFrame, path: str, made_from: str) -> None:
    """Writes the index of (doc_id, text). The facts are written last: without them there is no index."""
    given = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    given.mapInArrow(_segments, LISTS).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/lists")
    spark = docs.sparkSession
    lists = spark.read.schema(LISTS).parquet(f"{path}/lists")
    lists.filter("term is not null").groupBy("term").agg(F.sum("n").alias("df")).write.mode("overwrite").parquet(f"{path}/terms")

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = [_unpacked({"tfs": x}, "tfs") for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([len(x) for x in lengths], pa.int64()), pa.array([int(x.sum()) for x in lengths], pa.int64())], ["n", "length"])

    total = lists.filter("term is null").select("tfs").mapInArrow(sizes, "n long, length long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("length"))
    total.select("n", "length", F.lit(made_from).alias("made_from")).coalesce(1).write.mode("overwrite").parquet(f"{path}/facts")


def load(spark: SparkSession, path: str, made_from: str) -> Index | None:
    """The index at ``path``, or None where there is none or it was made from something else."""
    try:
        facts = spark.read.parquet(f"{path}/facts").first()
    except AnalysisException:
        return None
    if facts is None or facts["made_from"] != made_from:
        return None
    return Index(spark, path, facts["n"], facts["length"] / max(1, facts["n"]))


def ensure(docs: DataFrame, folder: str | None = None) -> Index:
    """The index of these documents in ``folder`` (the session's shared one where none is given), built
    where it is missing or was made from other documents."""
    spark = docs.sparkSession
    made_from = fingerprint(docs)
    path = f"{folder}/index" if folder else f"{checkpoint_dir(spark).rstrip('/')}/text-index-{made_from}"
    found = load(spark, path, made_from)
    if found is None:
        build(docs, path, made_from)
        found = load(spark, path, made_from)
    return found


class _Segment:
    """The posting lists of a segment for some terms, decoded as far as their block maxima."""

    def __init__(self, rows: list[dict], avg_len: float) -> None:
        head = next(r for r in rows if r["term"] is None)
        self.ids = np.frombuffer(head["places"], np.int64)
        self.norm = S.K1 * (1 - S.B + S.B * _unpacked(head, "tfs") / avg_len)
        self.windows = -(-len(self.ids) // WINDOW)
        self.lists, self.bounds = {}, {}
        for r in rows:
            if r["term"] is not None:
                window, counts = np.cumsum(_unpacked(r, "steps")), _unpacked(r, "counts")
                most = _unpacked(r, "most")
                peak = most * (S.K1 + 1) / (most + S.K1 * (1 - S.B + S.B * _unpacked(r, "least") / avg_len))
                self.lists[r["term"]] = (window, np.concatenate([[0], np.cumsum(counts)]), r)
                self.bounds[r["term"]] = window, peak
        self.opened: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def parts(self, term: str) -> tuple[np.ndarray, np.ndarray]:
        """Document numbers of a term, and its share of their scores before its weight."""
        if term not in self.opened:
            window, starts, r = self.lists[term]
            number = np.repeat(window * WINDOW, np.diff(starts)) + _unpacked(r, "places")
            tf = _unpacked(r, "tfs")
            self.opened[term] = number, tf * (S.K1 + 1) / (tf + self.norm[number])
        return self.opened[term]

    def best(self, weights: dict[str, float], k: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, rounded scores) of the k best documents of one query, or of all that have a term of it."""
        known = [(t, w) for t, w in weights.items() if t in self.lists]
        bound = np.zeros(self.windows)
        for term, weight in known:
            window, peak = self.bounds[term]
            bound[window] += weight * peak
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        ids, scores, at, size = np.zeros(0, np.int64), np.zeros(0), 0, OPENED if k else max(1, len(order))
        total = np.zeros(len(self.ids))
        while at < len(order) and (len(ids) < (k or 0) or k is None or bound[order[at]] >= scores[-1] - 1e-6):
            fresh = order[at : at + size]
            at, size = at + size, 2 * size
            for term, weight in known:
                window, starts, _ = self.lists[term]
                number, part = self.parts(term)
                place = np.searchsorted(window, fresh)
                place = place[(place < len(window)) & (window[np.minimum(place, len(window) - 1)] == fresh)]
                low, size_of = starts[place], starts[place + 1] - starts[place]
                some = np.repeat(low - np.cumsum(size_of) + size_of, size_of) + np.arange(size_of.sum())
                total[number[some]] += weight * part[some]
            spots = (fresh[:, None] * WINDOW + np.arange(WINDOW)).ravel()
            spots = spots[spots < len(self.ids)]
            spots = spots[total[spots] > 0]
            ids, scores = np.concatenate([ids, self.ids[spots]]), np.concatenate([scores, S.rounded(total[spots])])
            keep = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[keep], scores[keep]
        return ids, scores


def _search(index: Index, asked: list[tuple[int, list[str]]], k: int | None) -> DataFrame:
    spark = index.spark
    terms = sorted({t for _, ts in asked for t in ts})
    wanted = spark.createDataFrame(pa.table({"term": pa.array([*terms, None], pa.string())}))
    df = {r["term"]: r["df"] for r in index.terms.join(F.broadcast(wanted), "term", "left_semi").collect()}  # as many as the queries' terms
    weight = {t: max(float(np.log((index.n - d + 0.5) / (d + 0.5) + 1)), 1e-9) for t, d in df.items()}
    sent = spark.sparkContext.broadcast([(q, {t: weight[t] for t in ts if t in weight}) for q, ts in asked])  # bounded by the query set
    avg_len = index.avg_len

    def score(table: pa.Table) -> pa.Table:
        segment = _Segment(table.to_pylist(), avg_len)
        names, ids, scores = [], [], []
        for query, weights in sent.value:
            found, worth = segment.best(weights, k)
            names.append(np.full(len(found), query, np.int64))
            ids.append(found)
            scores.append(worth)
        return pa.table({n: np.concatenate(c) if c else np.zeros(0, t) for n, c, t in (("query_id", names, np.int64), ("doc_id", ids, np.int64), ("score", scores, np.float64))})

    lists = index.lists.join(F.broadcast(wanted.withColumnRenamed("term", "t")), F.col("term").eqNullSafe(F.col("t")), "left_semi")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # small rows, much work: not to be coalesced
    return lists.repartition(tasks, "segment").groupBy("segment").applyInArrow(score, S.PAIRS)


def bm25(queries: DataFrame, index: Index, k: int | None = None) -> DataFrame:
    """(query_id, doc_id, score) of the pairs that share a term, or, with ``k``, of at least each query's
    best k: as :func:`search.bm25`, from the index."""
    out = None
    for asked in S.stated_sets(queries):
        one = _search(index, [(q, sorted(set(S.words_of(text)))) for q, text in asked], k)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else index.spark.createDataFrame([], S.PAIRS)


def stats(index: Index) -> DataFrame:
    """(term, df, idf) of all terms."""
    return index.terms.select("term", "df", F.round(S.idf(F.lit(index.n), F.col("df")), 6).alias("idf"))
