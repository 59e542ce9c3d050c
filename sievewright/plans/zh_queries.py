"""Queries with the Chinese vocabularies, on narratives that are made from the documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.operators import corpus as C
from sievewright.operators import zh_pack as Z
from sievewright.operators.rules import Ladder
from sievewright.plans.corpus_queries import facet_sql
from sievewright.plans.registry import query
from sievewright.session import table

#: What the tellers say. Three of these stand before each document's own text.
SAID = (
    "我在臉書看到貼文", "賣家要我加LINE", "後來私訊詢問並下單", "對方說要實名認證", "客服打來說要驗證碼", "我去超商匯款", "之後又匯了第二筆",
    "帳戶的存款被盜領", "加入投資群組後老師帶單", "下載APP註冊平台會員", "入金三萬元", "後來加碼並追加資金", "平台說要繳保證金", "現在無法出金",
    "網路上的朋友用手機聯絡", "社群裡有人求職", "長輩收到簡訊", "我寄出提款卡", "只是想問問",
)


def cases(spark, sf_dir) -> DataFrame:
    """(doc_id, text): three sentences, chosen by id and length, and the whole text of the document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    said, n = F.array(*[F.lit(s) for s in SAID]), len(SAID)
    pick = lambda at: F.element_at(said, (F.pmod(at, F.lit(n)) + 1).cast("int"))
    own = F.col("doc_id")
    return docs.select("doc_id", F.concat(pick(own), F.lit("，"), pick(F.floor(own / n)), F.lit("。"), pick(F.char_length("text")), F.lit("。"), "text").alias("text"))


_LIST = "[" + ", ".join(f"'{s}'" for s in SAID) + "]"
_PICK = [f"{_LIST}[1 + (({at}) % {len(SAID)})::INT]" for at in ("doc_id", f"doc_id // {len(SAID)}", "length(coalesce(text, ''))")]
CASES = f"zc AS (SELECT doc_id, {_PICK[0]} || '，' || {_PICK[1]} || '。' || {_PICK[2]} || '。' || coalesce(text, '') AS text FROM documents)"


def _joined(c: Column) -> Column:
    return F.array_join(c, ",")


@query(f"WITH {CASES} SELECT doc_id, " + ", ".join(f"array_to_string({facet_sql('text', t)}, ',') AS {name}" for name, t in Z.FACETS.items()) + " FROM zc")
def zh_facets(spark, sf_dir):
    tagged = C.derive_facets(cases(spark, sf_dir), "text", Z.FACETS)
    return tagged.select("doc_id", *[_joined(F.col("facets")[name]).alias(name) for name in Z.FACETS])


_WIDE = "flatten([" + ", ".join(f"CASE WHEN contains(text, '{g}') THEN {list(vs)} ELSE [] END" for g, vs in Z.CHANNEL_GROUPS.items()) + "])"


@query(f"WITH {CASES} SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat({facet_sql('text', Z.FACETS['channel'])}, {_WIDE}))), ',') AS channels, array_to_string({facet_sql('text', Z.FACETS['category'])}, ',') AS categories FROM zc")
def zh_parse(spark, sf_dir):
    """Filters that a narrative names, where names of groups stand for all their channels."""
    said = C.parse_query(F.col("text"), Z.FACETS, Z.CHANNEL_GROUPS)
    of = lambda name: F.coalesce(F.try_element_at("filters", F.lit(name)), F.array().cast("array<string>"))
    return cases(spark, sf_dir).select("doc_id", said.alias("filters")).select("doc_id", _joined(F.array_sort(of("channel"))).alias("channels"), _joined(of("category")).alias("categories"))


def ladder_sql(name: str, ladder: Ladder) -> str:
    """SELECT of a ladder's account of the table zc."""
    has = lambda n: f"list_contains(s, {n})"
    total = lambda parts: " + ".join(f"({p})::INT" for p in parts) or "0"
    rungs = " ".join(f"WHEN {' OR '.join([has(n) for n in stages] + ['pays >= 2'] * (rung == 'REPEATED'))} THEN '{rung}'" for rung, stages in ladder.rungs)
    signs = [f"regexp_matches(text, '{p}')" for _, p, _ in ladder.universal]
    sure = total([has(n) for n in ladder.decisive] + [f"{sign} AND NOT {has(same)}" for sign, (_, _, same) in zip(signs, ladder.universal)])
    found = ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN {n} END" for n, p in ladder.patterns.items())
    return f"""SELECT doc_id, '{name}' AS ladder, array_to_string(s, ',') AS stages, pays AS payments,
  CASE WHEN shared AND h IN ('NONE', 'PAID', 'REPEATED') THEN 'CREDENTIALS' ELSE h END AS harm,
  CASE WHEN sure >= 1 THEN 'SCAM' WHEN odd >= 2 THEN 'LIKELY' ELSE 'UNKNOWN' END AS verdict,
  CASE WHEN sure >= 2 THEN 'HIGH' WHEN sure = 1 OR odd >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS confidence
FROM (SELECT *, CASE {rungs} ELSE 'NONE' END AS h, {' OR '.join(signs)} AS shared, {sure} AS sure, {total([has(n) for n in ladder.suspicious] + ['pays >= 2'])} AS odd
  FROM (SELECT *, CASE WHEN {has(ladder.pay)} THEN CASE WHEN regexp_matches(text, '{ladder.repeat}') THEN 2 ELSE 1 END ELSE 0 END AS pays
    FROM (SELECT doc_id, text, list_filter([{found}], lambda x: x IS NOT NULL) AS s FROM zc)))"""


LADDERS = {"shopping": Z.SHOPPING, "investment": Z.INVESTMENT}


@query(f"WITH {CASES} " + " UNION ALL ".join(ladder_sql(name, ladder) for name, ladder in LADDERS.items()))
def zh_harm(spark, sf_dir):
    """How far each narrative went on the ladder of each kind."""
    told = cases(spark, sf_dir)
    out = None
    for name, ladder in LADDERS.items():
        one = ladder.assess(told).select("doc_id", F.lit(name).alias("ladder"), _joined(F.col("stages").cast("array<string>")).alias("stages"), "payments", "harm", "verdict", "confidence")
        out = one if out is None else out.unionByName(one)
    return out
