"""Retrieval queries: benchmark items against documents, and vectors against vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievewright.functions import masking as M
from sievewright.functions import text as T
from sievewright.operators import metrics, text_index
from sievewright.operators import search as S
from sievewright.plans import vocab as V
from sievewright.operators import corpus as C
from sievewright.plans.corpus_queries import facet_sql, mask_sql
from sievewright.plans.registry import query
from sievewright.session import ship, table

TOK = "list_filter(regexp_split_to_array(lower({}), '[^A-Za-z0-9一-鿿]+'), lambda s: s <> '')"
BM25 = f"""
d AS (SELECT doc_id, {TOK.format('text')} AS ts FROM documents),
tf AS (SELECT doc_id, greatest(len(ts), 1) AS l, term, count(*) AS tf FROM (SELECT doc_id, ts, unnest(ts) AS term FROM d) GROUP BY doc_id, l, term),
st AS (SELECT count(*) AS n, avg(greatest(len(ts), 1)) AS al FROM d),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT item_id AS query_id, unnest(list_distinct({TOK.format('text')})) AS term FROM benchmark),
bm AS (SELECT query_id, doc_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5) + 1), 1e-9) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / al))), 6) AS score
       FROM q JOIN df USING (term) JOIN tf USING (term), st GROUP BY query_id, doc_id),
bmr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm)"""
GRAMS = "list_distinct(list_transform(range(1, length({0})), lambda i: c[i] || c[i + 1]))"
OVERLAP = f"""
og AS (SELECT item_id AS query_id, {GRAMS.format('text')} AS g FROM (SELECT *, string_split(text, '') AS c FROM benchmark)),
od AS (SELECT doc_id, unnest({GRAMS.format('text')}) AS gram FROM (SELECT *, string_split(text, '') AS c FROM documents)),
ov AS (SELECT query_id, doc_id, round(count(*) / n::DOUBLE, 6) AS score FROM (SELECT query_id, len(g) AS n, unnest(g) AS gram FROM og) JOIN od USING (gram) GROUP BY query_id, doc_id, n),
ovr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ov)"""


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text", "source", F.col("lang").alias("label"))


def items(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def index(spark, sf_dir):
    """The stored index of the documents; the first search of a session builds it."""
    ship(spark)
    return text_index.ensure(docs(spark, sf_dir).select("doc_id", "text"))


def bm25(spark, sf_dir, k=None):
    return text_index.bm25(items(spark, sf_dir), index(spark, sf_dir), k)


def overlap(spark, sf_dir, k=None, least=None):
    ship(spark)
    return S.overlap(items(spark, sf_dir), docs(spark, sf_dir), k, least)


@query(f"WITH {BM25} SELECT query_id, doc_id, score, rank FROM bmr WHERE rank <= 5")
def bm25_search(spark, sf_dir):
    return S.ranked(bm25(spark, sf_dir, 5), 5)


def flagship(spark, sf_dir):
    """BM25 top 5 per item, hydrated, masked, then excerpted."""
    hits = bm25_search(spark, sf_dir)
    found = hits.join(docs(spark, sf_dir), "doc_id")
    return found.select("query_id", "rank", "doc_id", "source", "score", T.excerpt(M.mask_native(F.col("text"))).alias("excerpt"))


@query(f"WITH {BM25} SELECT query_id, rank, doc_id, source, lang AS label, score, substr({mask_sql('text')}, 1, 120) AS excerpt FROM bmr JOIN documents USING (doc_id) WHERE rank <= 5")
def hydrate_hits(spark, sf_dir):
    hits = bm25_search(spark, sf_dir).join(docs(spark, sf_dir), "doc_id")
    return hits.select("query_id", "rank", "doc_id", "source", "label", "score", T.excerpt(M.mask_native(F.col("text"))).alias("excerpt"))


@query(f"WITH {BM25} SELECT query_id, doc_id, score, rank, round(score / max(score) OVER (PARTITION BY query_id), 6) AS normalised FROM bmr WHERE rank <= 50")
def bm25_normalised(spark, sf_dir):
    return S.max_normalised(S.ranked(bm25(spark, sf_dir, 50), 50))


@query(f"WITH {BM25} SELECT doc_id, term, tf FROM tf")
def term_freq(spark, sf_dir):
    return S.postings(docs(spark, sf_dir))


@query(f"WITH {BM25} SELECT term, df, round(greatest(ln((n - df + 0.5) / (df + 0.5) + 1), 1e-9), 6) AS idf FROM df, st")
def bm25_stats(spark, sf_dir):
    return text_index.stats(index(spark, sf_dir))


@query(f"WITH {OVERLAP} SELECT query_id, doc_id, score, rank FROM ovr WHERE rank <= 5 AND score > 0")
def overlap_search(spark, sf_dir):
    return S.ranked(overlap(spark, sf_dir, 5), 5).filter("score > 0")


@query(f"WITH {OVERLAP} SELECT query_id, doc_id, score, rank FROM ovr WHERE rank <= 20")
def topk_search(spark, sf_dir):
    return S.ranked(overlap(spark, sf_dir, 20), 20)


def vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e.select(F.col("vec_id").alias("doc_id"), "embedding")


VEC = """
vq AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0),
vs AS (SELECT query_id, vec_id AS doc_id, round(list_inner_product(q, embedding::DOUBLE[]), 6) AS score FROM vq, embeddings),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM vs)"""


@query(f"WITH {VEC} SELECT query_id, doc_id, score, rank FROM vr WHERE rank <= 10")
def vector_topk(spark, sf_dir):
    ship(spark)
    return S.vector_topk(*vectors(spark, sf_dir), 10)




def _fuse(weights: str) -> str:
    return f"""
arms AS (SELECT query_id, doc_id, rank, {weights.split('|')[0]} AS w FROM bmr WHERE rank <= 50 UNION ALL SELECT query_id, doc_id, rank, {weights.split('|')[1]} FROM ovr WHERE rank <= 50),
fused AS (SELECT query_id, doc_id, round(sum(w / ({weights.split('|')[2]} + rank)), 9) AS score FROM arms GROUP BY query_id, doc_id),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, count(*) OVER (PARTITION BY query_id) AS n FROM fused)"""


def _arms(spark, sf_dir):
    return S.ranked(bm25(spark, sf_dir, S.POOL), S.POOL), S.ranked(overlap(spark, sf_dir, S.POOL), S.POOL)


@query(f"WITH {BM25}, {OVERLAP}, {_fuse('2.0::DOUBLE|1.0::DOUBLE|10')} SELECT query_id, doc_id, score, rank, round(1 - (rank - 1) / n::DOUBLE, 6) AS display FROM fr")
def rrf_fusion(spark, sf_dir):
    a, b = _arms(spark, sf_dir)
    return S.rrf([(a, 2.0), (b, 1.0)], k=10)


@query(f"WITH {BM25}, {OVERLAP}, {_fuse('1.0::DOUBLE|1.0::DOUBLE|60')} SELECT query_id, doc_id, score, rank FROM fr")
def rrf_unweighted(spark, sf_dir):
    a, b = _arms(spark, sf_dir)
    return S.rrf([(a, 1.0), (b, 1.0)], k=60, shown=False)


_T = "[" + ", ".join(f"'{t}'" for t in V.TACTIC) + "]"
_D = " OR ".join(f"contains(text, '{t}')" for t in V.DISTRESS)


@query(f"""WITH {OVERLAP}, gq AS (SELECT item_id AS query_id, list_filter({_T}, lambda t: contains(text, t)) AS qt FROM benchmark WHERE len(list_filter({_T}, lambda t: contains(text, t))) > 0 OR {_D}),
gd AS (SELECT doc_id, list_filter({_T}, lambda t: contains(text, t)) AS dt FROM documents),
gs AS (SELECT query_id, doc_id, score, len(qt) AS n, len(list_intersect(qt, dt)) AS s FROM ov JOIN gq USING (query_id) JOIN gd USING (doc_id)),
gn AS (SELECT *, count(*) FILTER (s > 0 AND n > 0) OVER (PARTITION BY query_id) AS c FROM gs),
gr AS (SELECT query_id, doc_id, round(least(1.0, score + CASE WHEN n > 0 THEN 0.15::DOUBLE * s / n ELSE 0 END), 6) AS score FROM gn WHERE c < 20 OR (s > 0 AND n > 0))
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM gr QUALIFY rank <= 5 AND score > 0""")
def gated_search(spark, sf_dir):
    ship(spark)
    return S.gated(items(spark, sf_dir), docs(spark, sf_dir), list(V.TACTIC), list(V.DISTRESS), 5)


_DIV = """dv AS (SELECT query_id, doc_id, score, lang AS label, row_number() OVER (PARTITION BY query_id, coalesce(nullif(lang, ''), doc_id::VARCHAR) ORDER BY score DESC, doc_id) AS best FROM ov JOIN documents USING (doc_id) WHERE score >= {0})"""


@query(f"WITH {OVERLAP}, {_DIV.format(0.6)} SELECT query_id, doc_id, score, label, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM dv WHERE best = 1 QUALIFY rank <= 3")
def diversified_search(spark, sf_dir):
    ship(spark)
    return S.diversified(S.overlap_groups(items(spark, sf_dir), docs(spark, sf_dir), 3, 0.6), docs(spark, sf_dir), 3, 0.6).drop("best")


_CHAN = facet_sql("text", V.TABLES["channel"])


@query(f"""WITH {OVERLAP}, ff AS (SELECT doc_id, lang FROM documents WHERE len(list_intersect({_CHAN}, ['mail'])) > 0),
fd AS (SELECT query_id, doc_id, score, lang AS label, row_number() OVER (PARTITION BY query_id, coalesce(nullif(lang, ''), doc_id::VARCHAR) ORDER BY score DESC, doc_id) AS best FROM ov JOIN ff USING (doc_id)),
fk AS (SELECT query_id, greatest(3, count(*)) AS k FROM fd WHERE best = 1 GROUP BY query_id)
SELECT query_id, doc_id, score, label, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fd JOIN fk USING (query_id) WHERE best = 1 QUALIFY rank <= any_value(k) OVER (PARTITION BY query_id)""")
def faceted_search(spark, sf_dir):
    """Facets filter first; then no score is too low, and k grows to the number of labels."""
    kept = C.derive_facets(docs(spark, sf_dir), "text", V.TABLES).filter(C.facet_match(F.col("facets"), F.create_map(F.lit("channel"), F.array(F.lit("mail"))))).drop("facets")
    ship(spark)
    return S.diversified(S.overlap_groups(items(spark, sf_dir), kept), kept, 3, 0.6, filtered=True).drop("best")


@query(f"WITH {OVERLAP} SELECT query_id, doc_id, score, rank FROM ovr WHERE score >= 0.6 AND rank <= 10")
def threshold_search(spark, sf_dir):
    return S.ranked(overlap(spark, sf_dir, 10), 10).filter("score >= 0.6")


@query(f"""WITH {BM25}, {OVERLAP}, hi AS (SELECT query_id, doc_id, score, rank FROM ovr WHERE rank <= 5 AND score >= 0.97), un AS (SELECT *, 0 AS tier FROM hi UNION ALL SELECT query_id, doc_id, score, rank, 1 FROM bmr WHERE rank <= 5)
SELECT query_id, doc_id, score, rank, tier, tier > 0 AS degraded FROM un QUALIFY tier = min(tier) OVER (PARTITION BY query_id)""")
def tiered_search(spark, sf_dir):
    first = S.ranked(overlap(spark, sf_dir, 5), 5).filter("score >= 0.97")
    return S.tiered([first, S.ranked(bm25(spark, sf_dir, 5), 5)])


_GOLD = "gold AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def gold(spark, sf_dir):
    """(query_id, doc_id) of the documents that hold an item's passage whole. One pass over the
    documents: each task looks for all items of the stated set, whose texts it has."""
    ship(spark)
    return S.over_sets(items(spark, sf_dir), lambda asked: _holders(docs(spark, sf_dir), asked), schema="query_id long, doc_id long")


def _holders(documents, asked):
    import ahocorasick
    import pyarrow as pa

    sent = documents.sparkSession.sparkContext.broadcast(asked)

    def run(batches):
        by_text = {}
        for q, text in sent.value:
            by_text.setdefault(text, []).append(q)
        everywhere = by_text.pop("", [])
        found = ahocorasick.Automaton()
        for text, names in by_text.items():
            found.add_word(text, names)
        if by_text:
            found.make_automaton()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text is not None:
                    held = {q for _, names in found.iter(text) for q in names} if by_text else set()
                    rows += [(q, doc) for q in sorted(held | set(everywhere))]
            yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in rows], pa.int64()), pa.array([d for _, d in rows], pa.int64())], names=["query_id", "doc_id"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "query_id long, doc_id long")


@query(f"""WITH {BM25}, {_GOLD}, top AS (SELECT query_id, doc_id FROM bmr WHERE rank <= 5)
SELECT query_id, doc_id, (query_id, doc_id) IN (SELECT (query_id, doc_id) FROM gold) AS is_gold FROM (SELECT * FROM top UNION SELECT * FROM gold)""")
def judging_pool(spark, sf_dir):
    g = gold(spark, sf_dir).withColumn("g", F.lit(True))
    pool = bm25_search(spark, sf_dir).select("query_id", "doc_id").union(g.select("query_id", "doc_id")).distinct()
    return pool.join(g, ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.coalesce("g", F.lit(False)).alias("is_gold"))


@query(f"WITH {BM25} SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id::VARCHAR || query_id::VARCHAR) AS place FROM bmr WHERE rank <= 5")
def judging_order(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy(F.concat(F.col("doc_id").cast("string"), F.col("query_id").cast("string")))
    return bm25_search(spark, sf_dir).select("query_id", "doc_id", F.row_number().over(w).alias("place"))


def first_hits(spark, sf_dir, ranked):
    """(query_id, r) of the items that have relevant documents: the rank of the first hit, or null."""
    g = gold(spark, sf_dir)
    hits = ranked.join(g, ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("rank").alias("r"))
    return g.select("query_id").distinct().join(hits, "query_id", "left")


_HIT = "SELECT query_id, min(rank) AS r FROM (SELECT DISTINCT query_id FROM gold) g LEFT JOIN (SELECT query_id, rank FROM {0} JOIN gold USING (query_id, doc_id)) h USING (query_id) GROUP BY query_id"


@query(f"WITH {BM25}, {_GOLD}, h AS ({_HIT.format('bmr')}) SELECT round(avg(CASE WHEN r <= 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_rate FROM h")
def recall_at_k(spark, sf_dir):
    return metrics.hit_rate(first_hits(spark, sf_dir, S.ranked(bm25(spark, sf_dir, 10), 10)), 5)


@query(f"WITH {BM25}, {_GOLD}, h AS ({_HIT.format('bmr')}) SELECT round(avg(CASE WHEN r <= 10 THEN 1.0::DOUBLE / r ELSE 0 END), 6) AS mrr FROM h")
def mrr_at_k(spark, sf_dir):
    return metrics.mean_reciprocal(first_hits(spark, sf_dir, S.ranked(bm25(spark, sf_dir, 10), 10)), 10)


@query(f"""WITH {BM25}, {OVERLAP}, {_GOLD}, hb AS ({_HIT.format('bmr')}), ho AS ({_HIT.format('ovr')}), al AS (SELECT 'bm25' AS arm, r FROM hb UNION ALL SELECT 'overlap', r FROM ho)
SELECT arm, round(avg((coalesce(r, 99999) <= 1)::INT), 6) AS top1, round(avg((coalesce(r, 99999) <= 5)::INT), 6) AS r5, round(avg((coalesce(r, 99999) <= 10)::INT), 6) AS r10 FROM al GROUP BY arm""")
def arm_comparison(spark, sf_dir):
    out = None
    for arm, scores in (("bm25", bm25(spark, sf_dir, 10)), ("overlap", overlap(spark, sf_dir, 10))):
        r = first_hits(spark, sf_dir, S.ranked(scores, 10))
        at = lambda k: F.round(F.avg(F.coalesce(F.col("r") <= k, F.lit(False)).cast("double")), 6)
        one = r.agg(at(1).alias("top1"), at(5).alias("r5"), at(10).alias("r10")).withColumn("arm", F.lit(arm))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {BM25} SELECT query_id, max(score) AS best, max(score) FILTER (rank = 10) AS tenth, max(score) FILTER (rank = 100) AS hundredth, round(median(score), 6) AS median, count(*) FILTER (score >= 5) AS n_above FROM bmr GROUP BY query_id")
def score_distribution(spark, sf_dir):
    from sievewright.operators import analytics

    return analytics.score_distribution(bm25(spark, sf_dir), 5.0)


@query("""WITH {0}, vl AS (SELECT query_id, e.label AS y_pred, count(*) AS n, sum(score) AS s FROM vr JOIN embeddings e ON e.vec_id = doc_id WHERE rank <= 10 AND doc_id <> query_id GROUP BY query_id, e.label),
vp AS (SELECT query_id, y_pred FROM vl QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, y_pred) = 1)
SELECT query_id, e.label AS y_true, y_pred FROM vp JOIN embeddings e ON e.vec_id = query_id""".replace("{0}", VEC))
def knn_label(spark, sf_dir):
    """The most frequent label among a vector's nearest others."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    near = vector_topk(spark, sf_dir).filter("doc_id <> query_id").join(e, F.col("doc_id") == e["vec_id"]).groupBy("query_id", F.col("label").alias("y_pred")).count()
    best = near.withColumn("p", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("count"), "y_pred"))).filter("p = 1")
    return best.join(e, F.col("query_id") == e["vec_id"]).select("query_id", F.col("label").alias("y_true"), "y_pred")
