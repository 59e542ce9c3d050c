"""Dense retrieval from end to end: an index with a fingerprint, its check on loading, and a hybrid
search that says so where it has to do without."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.operators import models
from sievewright.operators import search as S


def fingerprint(docs: DataFrame) -> str:
    """Of ids and texts, whatever their order: changes where any row does."""
    h = F.xxhash64(F.col("doc_id").cast("string"), "text")
    r = docs.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("s")).first()
    return f"{r['n']}-{(r['x'] or 0) & (1 << 64) - 1:016x}-{r['s'] or 0}"


def build(docs: DataFrame, make: Callable[[], models.Embedder], model: str, path: str, batch: int = 32) -> None:
    """Writes the vectors of all documents, and what they were made from beside them."""
    made = models.embed(docs.select("doc_id", "text"), "text", make, batch).select("doc_id", "embedding")
    made.write.mode("overwrite").parquet(f"{path}/vectors")
    facts = docs.sparkSession.range(1).select(F.lit(model).alias("model"), F.lit(fingerprint(docs)).alias("fingerprint"))
    facts.write.mode("overwrite").parquet(f"{path}/facts")


def load(spark: SparkSession, path: str, docs: DataFrame, model: str) -> tuple[DataFrame | None, str]:
    """(vectors, "") of an index of this model over these documents, or (None, why not)."""
    try:
        facts = spark.read.parquet(f"{path}/facts").first()
        vectors = spark.read.parquet(f"{path}/vectors")
    except AnalysisException:
        return None, "no index"
    if facts["model"] != model:
        return None, "index of another model"
    if facts["fingerprint"] != fingerprint(docs):
        return None, "index of other documents"
    return vectors, ""


def hybrid(queries: DataFrame, docs: DataFrame, index: DataFrame | None, reason: str, make: Callable[[], models.Embedder], k: int = 60, pool: int = S.POOL) -> DataFrame:
    """(query_id, doc_id, score, rank, degraded, reason): BM25 and dense ranks fused; BM25's alone,
    marked as degraded, where there is no index that fits."""
    arms = [(S.ranked(S.bm25(queries, docs, pool), pool), 1.0)]
    if index is not None:
        asked = models.embed(queries.select("query_id", "query"), "query", make).select("query_id", "embedding")
        arms.append((S.vector_topk(asked, index, pool), 1.0))
    fused = S.rrf(arms, k=k, pool=pool, shown=False)
    return fused.withColumns({"degraded": F.lit(index is None), "reason": F.lit(reason)})
