"""Queries on actions, steps, health, hybrid search and small text helpers."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from sievewright.functions import text as T
from sievewright.operators import corpus as C
from sievewright.operators import dense, models, steps
from sievewright.operators import rules as R
from sievewright.operators import search as S
from sievewright.plans import rules_queries as RQ
from sievewright.plans import search_queries as Q
from sievewright.plans import vocab as V
from sievewright.plans.corpus_queries import facet_sql
from sievewright.plans.registry import query
from sievewright.session import passing, ship, table
from sievewright.sources import versioned

_OWN = "['Call 165 about ' || harm, 'Keep records of ' || harm]"
_SIGNS = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{a}' END" for p, a in V.SIGNS) + "], lambda x: x IS NOT NULL)"
_TAIL = "[" + ", ".join(f"'{a}'" for a in V.TAIL) + "]"
_ACTIONS = f"""{RQ._M}, o AS (SELECT a.doc_id, harm, stages, {_OWN} AS own, {_SIGNS} AS s FROM a JOIN documents USING (doc_id)),
b AS (SELECT *, CASE WHEN len(s) > 0 THEN list_concat(list_concat(s, {_TAIL}), list_filter(own, lambda x: NOT contains(x, '165'))) ELSE own END AS acts FROM o),
c AS (SELECT doc_id, CASE WHEN harm = 'REPEATED' AND NOT list_contains(string_split(stages, ','), '5') THEN list_concat(['{V.NOT_AGAIN}'], acts[2:]) ELSE acts END AS acts FROM b)"""


def _actions(spark, sf_dir):
    a = V.LADDER.assess(table(spark, sf_dir, "documents"))
    own = F.array(F.concat(F.lit("Call 165 about "), "harm"), F.concat(F.lit("Keep records of "), "harm"))
    again = (F.col("harm") == "REPEATED") & ~F.array_contains("stages", 5)
    return a.select("doc_id", R.actions_for(F.col("text"), own, V.SIGNS, V.TAIL, "165", (again, V.NOT_AGAIN)).alias("acts"))


@query(f"WITH {_ACTIONS} SELECT doc_id, array_to_string(acts, '|') AS actions FROM c")
def actions_for(spark, sf_dir):
    return _actions(spark, sf_dir).select("doc_id", F.array_join("acts", "|").alias("actions"))


@query(f"WITH {_ACTIONS} SELECT doc_id, array_to_string(list_transform(list_reverse(acts), lambda x, i: i || '. ' || CASE WHEN starts_with(x, 'Keep') THEN '* ' ELSE '' END || x), '|') AS lines FROM c")
def ordered_actions(spark, sf_dir):
    """The actions in reverse order of urgency, put into their order."""
    acts = F.transform("acts", lambda a, i: F.struct((F.size("acts") - i).alias("order"), a.alias("text"), F.startswith(a, F.lit("Keep")).alias("preventive")))
    return _actions(spark, sf_dir).select("doc_id", F.array_join(R.ordered(acts), "|").alias("lines"))


def _figure(text):
    return int(re.search("[0-9]{6,18}", text).group())


def _ratio(figure):
    return 1_000_000 / int(figure)


@query("""WITH f AS (SELECT doc_id, try_cast(nullif(regexp_extract(text, '[0-9]{6,18}'), '') AS BIGINT) AS figure FROM documents)
SELECT doc_id, figure::VARCHAR AS figure, CASE WHEN figure <> 0 THEN round(1000000::DOUBLE / figure, 6) END AS ratio, (figure IS NULL)::INT + (figure IS NULL OR figure = 0)::INT AS n_failed, CASE WHEN figure <> 0 THEN 'ok' ELSE 'degraded' END AS status FROM f""")
def step_status(spark, sf_dir):
    """Two steps, the second of which reads the first one's value; failures stay in their rows."""
    ship(spark)
    done = steps.run_steps(table(spark, sf_dir, "documents").select("doc_id", "text"), [steps.Step("figure", "text", _figure, "long"), steps.Step("ratio", "figure", _ratio, "double")])
    return done.select("doc_id", F.col("figure").cast("string").alias("figure"), F.round("ratio", 6).alias("ratio"), F.size("degraded_reasons").alias("n_failed"), "status")


@query("""WITH h AS (SELECT count(*) > 0 AS a, count(*) = count(doc_id) AS b, count(*) = count(lang) AS c, min(length(text)) >= 1 AS d FROM documents)
SELECT 'rows' AS "check", true AS required, a AS ok, a AND b AS ready FROM h UNION ALL SELECT 'ids', true, b, a AND b FROM h UNION ALL SELECT 'languages', false, c, a AND b FROM h UNION ALL SELECT 'no_empty_text', false, coalesce(d, false), a AND b FROM h""")
def health(spark, sf_dir):
    n = F.count(F.lit(1))
    return steps.health(table(spark, sf_dir, "documents"), {"rows": (n > 0, True), "ids": (n == F.count("doc_id"), True), "languages": (n == F.count("lang"), False), "no_empty_text": (F.min(F.char_length("text")) >= 1, False)})


@query("""WITH d AS (SELECT doc_id, lang AS model, source FROM documents), gone AS (SELECT min(source) AS s FROM d), r AS (SELECT * FROM d WHERE model = 'de' AND doc_id % 3 = 0 AND source <> (SELECT s FROM gone))
SELECT doc_id, model, source FROM d WHERE source <> (SELECT s FROM gone) AND (model, source) NOT IN (SELECT (model, source) FROM r) UNION ALL SELECT doc_id, model, source FROM r""")
def index_maintenance(spark, sf_dir):
    """A table of parts by model and source: written, appended to, one source deleted, some parts replaced."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("model"), "source")
    kept = versioned.VersionedTable(spark, passing(spark, "parts"), ("model", "source"))
    kept.replace(rows.filter("doc_id % 2 = 0"))
    kept.append(rows.filter("doc_id % 2 = 1"))
    gone = rows.agg(F.min("source")).first()[0]
    kept.delete(lambda part: part["source"] == gone)
    kept.replace(rows.filter((F.col("model") == "de") & (F.col("doc_id") % 3 == 0) & (F.col("source") != gone)))
    return kept.read()


MODEL = "hashing-64"


def _hybrid(spark, sf_dir, built: bool):
    ship(spark)
    docs, path = Q.docs(spark, sf_dir), passing(spark, "index")
    if built:
        dense.build(docs, models.hashing_embedder, MODEL, path)
    index, why = dense.load(spark, path, docs, MODEL)
    return dense.hybrid(Q.items(spark, sf_dir), docs, index, why, models.hashing_embedder)


@query()
def hybrid_search(spark, sf_dir):
    """BM25 and vectors fused, over an index that is built, written and loaded again."""
    return _hybrid(spark, sf_dir, True)


@query(f"WITH {Q.BM25} SELECT query_id, doc_id, round(1.0::DOUBLE / (60 + rank), 9) AS score, rank, true AS degraded, 'no index' AS reason FROM bmr WHERE rank <= 50")
def hybrid_without_index(spark, sf_dir):
    return _hybrid(spark, sf_dir, False)


_HELD = "list_filter([" + ", ".join(f"'{t}'" for t in V.TACTIC) + "], lambda t: contains(text, t))"


@query(f"SELECT doc_id, CASE WHEN len({_HELD}) > 0 THEN array_to_string({_HELD}, '、') || '{T.QUESTION}' END AS question FROM documents")
def as_question(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.as_question(T.hits(F.col("text"), list(V.TACTIC))).alias("question"))


_SAID = ", ".join(f"CASE WHEN len({facet_sql('text', V.TABLES[k])}) > 0 THEN '{T.FILTER_LABELS[k]}＝' || array_to_string({facet_sql('text', V.TABLES[k])}, '／') END" for k in V.TABLES)


@query(f"SELECT doc_id, concat_ws('、', {_SAID}) AS said FROM documents")
def describe_filters(spark, sf_dir):
    facets = C.derive_facets(table(spark, sf_dir, "documents"), "text", V.TABLES)
    return facets.select("doc_id", T.describe(F.col("facets")).alias("said"))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter([regexp_replace(source, '\\s+', '', 'g'), lang, upper(lang), lang], lambda x: x IS NOT NULL AND x <> ''))), ',') AS variants FROM documents")
def label_variants(spark, sf_dir):
    lang = F.col("lang")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.label_variants(F.array("source", lang), F.array(F.upper(lang), lang)), ",").alias("variants"))


@query("SELECT doc_id, nullif(source, '') AS source, trim(coalesce(text, '')) = '' AS is_empty FROM documents")
def blank_to_null(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.blank_to_null(F.col("source")).alias("source"), T.is_empty(F.col("text")).alias("is_empty"))


@query("SELECT doc_id, md5('7:' || doc_id) AS shuffle_key FROM documents")
def seeded_shuffle(spark, sf_dir):
    return C.shuffled(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 7)


@query(f"WITH {Q.BM25}, {Q.OVERLAP} SELECT b.query_id, b.doc_id, coalesce(o.score, 0.0) AS vector_score FROM bmr b LEFT JOIN (SELECT * FROM ovr WHERE rank <= 5) o USING (query_id, doc_id) WHERE b.rank <= 5")
def pool_scores(spark, sf_dir):
    """The scores of a second arm for the first one's pool, 0 where it has none."""
    return S.pool_scores(Q.bm25_search(spark, sf_dir), Q.overlap_search(spark, sf_dir)).select("query_id", "doc_id", F.col("other").alias("vector_score"))


@query(f"""WITH {Q._GOLD}, j AS (SELECT DISTINCT query_id, doc_id FROM gold JOIN labels USING (doc_id) WHERE quality = 1)
SELECT query_id, doc_id, true AS judged FROM j UNION ALL SELECT query_id, doc_id, false FROM gold WHERE query_id NOT IN (SELECT query_id FROM j)""")
def judged_or_gold(spark, sf_dir):
    """What judges found relevant to an item; the passages it was made from where they found nothing."""
    gold = Q.gold(spark, sf_dir)
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return S.judged_or_gold(gold.join(good, "doc_id", "left_semi"), gold)
