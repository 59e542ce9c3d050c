"""Classifier, routing, session, metric and analytics queries on the standard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievewright.functions import text as T
from sievewright.operators import analytics as A
from sievewright.operators import metrics as E
from sievewright.operators import rules as R
from sievewright.operators import sessions
from sievewright.plans import vocab as V
from sievewright.plans.corpus_queries import HEARD, docs, heard, heard_turns, terms_sql
from sievewright.plans.registry import query
from sievewright.session import ship, table
from sievewright.streaming import chat


def hits_sql(c: str, terms) -> str:
    return "(" + " + ".join(f"contains({c}, '{t}')::INT" for t in terms) + ")" if terms else "0"


def keyword_sql(c: str, pos, neg) -> str:
    """Banker's rounding to four places is round_even in DuckDB."""
    e = f"greatest(0.0::DOUBLE, {hits_sql(c, pos)} - 0.5::DOUBLE * {hits_sql(c, neg)})"
    return f"round_even({e} / ({e} + 2), 4)"


def _pack_sql(p: R.Pack) -> str:
    base = keyword_sql("text", p.positives, p.negatives)
    if p.style == "factor":
        own, other = (f"regexp_matches(text, '(^|[^A-Za-z])({'|'.join(ts)})($|[^A-Za-z])')" for ts in (p.platform, p.others))
        return f"round_even(least(1.0, {base} * CASE WHEN {own} THEN 1.3::DOUBLE WHEN {other} THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END), 4)"
    on = terms_sql("text", p.platform)
    if p.style == "bonus":
        return f"least(1.0, {base} + CASE WHEN {on} THEN 0.15::DOUBLE ELSE 0.0 END)"
    low = f"least({base}, {p.hint_min}::DOUBLE)"
    return f"CASE WHEN regexp_matches(text, '{p.exclude}') THEN {low} WHEN ({base} > 0 OR NOT {terms_sql('text', p.negatives)}) AND {on} AND {terms_sql('text', p.decisive)} THEN greatest({base}, 0.6::DOUBLE) WHEN NOT {on} THEN {low} ELSE least(1.0, {base} + 0.15::DOUBLE) END"


_USABLE = [p for p in V.PACKS if p.usable]
SCORES = "sc AS (" + " UNION ALL ".join(f"SELECT doc_id, '{p.id}' AS module, {k} AS place, round({_pack_sql(p)}, 6) AS score, {p.priority} AS priority, {p.route_min} AS route_min, {p.hint_min} AS hint_min FROM documents" for k, p in enumerate(_USABLE)) + ")"
ROUTE = f"""{SCORES}, ro AS (SELECT doc_id, module, score, CASE WHEN score >= route_min THEN 0 ELSE 1 END AS kind, CASE WHEN score >= route_min THEN -score ELSE 0 END AS b, CASE WHEN score >= route_min THEN priority ELSE 0 END AS t, place FROM sc WHERE score >= hint_min),
rr AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY kind, b, t, place) AS rn FROM ro),
rt AS (SELECT d.doc_id, max(module) FILTER (rn = 1 AND kind = 0) AS prim, max(score) FILTER (rn = 1 AND kind = 0) AS score, coalesce(string_agg(module, ',' ORDER BY rn) FILTER (NOT (rn = 1 AND kind = 0)), '') AS also FROM documents d LEFT JOIN rr USING (doc_id) GROUP BY d.doc_id)"""


def routed(spark, sf_dir):
    r = R.route(docs(spark, sf_dir), V.PACKS, "doc_id", "text")
    return r.withColumn("score", F.round("score", 6))


@query(f"SELECT doc_id, {keyword_sql('text', V.PACKS[0].positives, V.PACKS[0].negatives)} AS score FROM documents")
def keyword_score(spark, sf_dir):
    p = V.PACKS[0]
    return docs(spark, sf_dir).select("doc_id", R.keyword_score(F.col("text"), p.positives, p.negatives).alias("score"))


@query(f"WITH {ROUTE} SELECT doc_id, prim AS \"primary\", score, also FROM rt")
def route(spark, sf_dir):
    return routed(spark, sf_dir)


@query(f"WITH {ROUTE} SELECT doc_id, prim AS \"primary\", score, also FROM rt")
def route_one_scan(spark, sf_dir):
    """As route, with the terms of all packs found in one pass."""
    ship(spark)
    return R.route(docs(spark, sf_dir), V.PACKS, "doc_id", "text", one_scan=True)


@query(f"WITH {ROUTE} SELECT doc_id, prim AS \"primary\", CASE WHEN prim IS NULL THEN 'UNCOVERED' WHEN prim <> 'c' OR coalesce(doc_id % 2 = 0, true) THEN 'COVERED' ELSE 'COVERED_LOCKED' END AS status FROM rt")
def coverage_status(spark, sf_dir):
    return R.coverage(routed(spark, sf_dir), V.PACKS, F.col("doc_id") % 2 == 0).select("doc_id", "primary", "status")


def stage_sql(c: str) -> str:
    return "CASE " + " ".join(f"WHEN {terms_sql(c, cues)} THEN '{name}'" for name, _, cues in reversed(V.STAGES)) + " ELSE '' END"


@query(f"SELECT doc_id, {stage_sql('text')} AS stage FROM documents")
def detect_stage(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", R.detect_stage(F.col("text"), V.STAGES).alias("stage"))


def _playbook(spark):
    rows = [(k, name, risk, [f"{name} first", f"{name} then"]) for k, (name, risk, _) in enumerate(V.STAGES)]
    return spark.createDataFrame(rows, "pos int, id string, risk string, actions array<string>")


@query(f"SELECT doc_id, CASE WHEN stage = '' THEN 'contact' ELSE stage END AS stage_id, CASE stage WHEN 'paid' THEN 'MEDIUM' WHEN 'drained' THEN 'HIGH' ELSE 'LOW' END AS risk FROM (SELECT doc_id, {stage_sql('text')} AS stage FROM documents)")
def compose_stage(spark, sf_dir):
    return R.compose(detect_stage(spark, sf_dir), _playbook(spark), "missing").select("doc_id", "stage_id", "risk")


@query(f"SELECT doc_id, CASE WHEN stage = '' THEN 'paid' ELSE stage END AS stage_id, ['1. ' || CASE WHEN stage = '' THEN 'paid' ELSE stage END || ' first', '2. ' || CASE WHEN stage = '' THEN 'paid' ELSE stage END || ' then'] AS steps FROM (SELECT doc_id, {stage_sql('text')} AS stage FROM documents)")
def compose_verdict(spark, sf_dir):
    return R.compose(detect_stage(spark, sf_dir), _playbook(spark), "paid").select("doc_id", "stage_id", "steps")


@query("SELECT doc_id, " + ", ".join(f"regexp_matches(text, '{p}') AS {n}" for n, p in V.MATRIX.items()) + " FROM documents")
def stage_matrix(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", *R.stage_matrix(F.col("text"), V.MATRIX))


_L = V.LADDER
_M = "m AS (SELECT doc_id, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN {n} END" for n, p in _L.patterns.items()) + f"], lambda x: x IS NOT NULL) AS s, regexp_matches(text, '{_L.repeat}') AS rep, regexp_matches(text, '{_L.universal[0][1]}') AS u FROM documents), p AS (SELECT *, CASE WHEN list_contains(s, 8) THEN CASE WHEN rep THEN 2 ELSE 1 END ELSE 0 END AS pays FROM m), h AS (SELECT *, CASE WHEN list_contains(s, 11) THEN 'DRAINED' WHEN list_contains(s, 9) THEN 'CREDENTIALS' WHEN pays >= 2 THEN 'REPEATED' WHEN list_contains(s, 8) THEN 'PAID' ELSE 'NONE' END AS h0, list_contains(s, 9)::INT + list_contains(s, 11)::INT + u::INT AS sure, list_contains(s, 4)::INT + list_contains(s, 5)::INT + (pays >= 2)::INT AS odd FROM p), a AS (SELECT doc_id, array_to_string(s, ',') AS stages, pays AS payments, CASE WHEN u AND h0 IN ('NONE', 'PAID', 'REPEATED') THEN 'CREDENTIALS' ELSE h0 END AS harm, CASE WHEN sure >= 1 THEN 'SCAM' WHEN odd >= 2 THEN 'LIKELY' ELSE 'UNKNOWN' END AS verdict, CASE WHEN sure >= 2 THEN 'HIGH' WHEN sure = 1 OR odd >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM h)"


def assessed(spark, sf_dir):
    return V.LADDER.assess(docs(spark, sf_dir)).withColumn("stages", F.array_join(F.col("stages").cast("array<string>"), ","))


@query(f"WITH {_M} SELECT doc_id, stages, payments, harm, verdict, confidence FROM a")
def harm_assess(spark, sf_dir):
    return assessed(spark, sf_dir).select("doc_id", "stages", "payments", "harm", "verdict", "confidence")


@query(f"WITH {_M} SELECT doc_id, CASE WHEN stages <> '' THEN lower(harm) ELSE {stage_sql('text')} END AS stage FROM a JOIN documents USING (doc_id)")
def detect_stage_e(spark, sf_dir):
    a = assessed(spark, sf_dir)
    return a.select("doc_id", F.when(F.col("stages") != "", F.lower("harm")).otherwise(R.detect_stage(F.col("text"), V.STAGES)).alias("stage"))


@query(f"WITH {_M} SELECT harm, verdict, count(*) AS n FROM a GROUP BY harm, verdict")
def stratum_counts(spark, sf_dir):
    return assessed(spark, sf_dir).groupBy("harm", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_M}, z AS (SELECT *, count(*) OVER (PARTITION BY harm, verdict) AS n, row_number() OVER (PARTITION BY harm, verdict ORDER BY doc_id) AS plc FROM a)
SELECT doc_id, harm, verdict FROM z QUALIFY row_number() OVER (PARTITION BY harm ORDER BY plc, n DESC, verdict, doc_id) <= 12""")
def stratified_sample(spark, sf_dir):
    return R.stratified(assessed(spark, sf_dir), ["harm", "verdict"], "doc_id", 12).select("doc_id", "harm", "verdict")


@query(f"WITH {_M} SELECT doc_id, harm, quality FROM a JOIN labels USING (doc_id) WHERE harm = 'NONE' AND quality = 0")
def rule_vs_gold_misses(spark, sf_dir):
    return assessed(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").filter("harm = 'NONE' and quality = 0").select("doc_id", "harm", "quality")


@query("SELECT doc_id * 7919 % 1000003 AS pos, doc_id, source FROM labels JOIN documents USING (doc_id)")
def keep_sample_order(spark, sf_dir):
    """Documents of a stated list of ids, each with its place in the list."""
    ids = table(spark, sf_dir, "labels").select("doc_id", (F.col("doc_id") * 7919 % 1000003).alias("pos"))
    return ids.join(docs(spark, sf_dir), "doc_id").select("pos", "doc_id", "source")


@query("""SELECT doc_id, list_filter(['thing', 'License', 'token'], lambda t: contains(text, t))[1] AS platform, CASE WHEN contains(text, '4111') OR contains(text, 'token') THEN 'card' WHEN contains(text, '+1 (') THEN 'phone' WHEN contains(text, '@mail') THEN 'mail' END AS payment, try_cast(nullif(regexp_extract(text, '([0-9]{1,3})\\s*(?:days?|天|日)', 1), '') AS INTEGER) AS days, 'LOW' AS confidence FROM documents""")
def extract_profile(spark, sf_dir):
    return R.extract_profile(docs(spark, sf_dir), "text", ["thing", "License", "token"], V.PAYMENTS).select("doc_id", "platform", "payment", "days", "confidence")


@query()
def profile_fields(spark, sf_dir):
    """The profile with the range of the first amount, the stage and a confidence for each field."""
    ship(spark)
    d = docs(spark, sf_dir)
    found = R.profile(d, "text", ["thing", "License", "token"], V.PAYMENTS, R.detect_stage(F.col("text"), V.STAGES))
    return found.select("doc_id", "platform", "payment", "amount_range", "stage", "days", "field_confidence")


@query("""WITH g AS (SELECT o_orderkey AS k, CASE WHEN o_totalprice > 300000 THEN 'HIGH' ELSE 'LOW' END AS risk, CASE WHEN o_orderkey % 3 = 0 THEN [] WHEN o_orderkey % 3 = 1 THEN ['call', ' '] ELSE ['call'] END AS actions, CASE WHEN o_orderkey % 2 = 0 THEN ['c1', ''] ELSE ['c1'] END AS ids, CASE WHEN o_orderkey % 5 = 0 THEN ' ' ELSE 'Ask a lawyer.' END AS d FROM orders),
v AS (SELECT *, list_filter([CASE WHEN risk = 'HIGH' AND k % 3 = 0 THEN 'severe_without_actions' END, CASE WHEN k % 2 = 0 THEN 'blank_case_id' END, CASE WHEN k % 3 = 1 THEN 'blank_action' END, CASE WHEN k % 5 = 0 THEN 'no_disclaimer' END], lambda x: x IS NOT NULL) AS violations FROM g)
SELECT k, violations, list_contains(violations, 'severe_without_actions') AS fatal, len(list_filter(actions, lambda x: trim(x) <> '')) AS n_actions, CASE WHEN trim(d) = '' THEN 'This is not legal advice.' ELSE d END AS disclaimer, len(violations) > 0 AS degraded FROM v""")
def guards(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        k.alias("k"), F.when(F.col("o_totalprice") > 300000, "HIGH").otherwise("LOW").alias("risk"),
        F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 3 == 1, F.array(F.lit("call"), F.lit(" "))).otherwise(F.array(F.lit("call"))).alias("actions"),
        F.when(k % 2 == 0, F.array(F.lit("c1"), F.lit(""))).otherwise(F.array(F.lit("c1"))).alias("case_ids"), F.when(k % 5 == 0, " ").otherwise("Ask a lawyer.").alias("disclaimer"),
    )
    return R.guards(rows).select("k", "violations", "fatal", F.size("actions").cast("long").alias("n_actions"), "disclaimer", "degraded")


@query("SELECT conv_id, array_to_string(list(text ORDER BY turn)[1:3], ' | ') AS shown, greatest(count(*) - 3, 0) AS more FROM conversations GROUP BY conv_id")
def case_cap(spark, sf_dir):
    """At most three are shown, the rest are counted."""
    from pyspark.sql import Window

    all_ = table(spark, sf_dir, "conversations")
    first = all_.withColumn("at", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).filter("at <= 3")
    c = first.join(all_.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "conv_id")
    shown = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), " | ")
    return c.groupBy("conv_id", "n").agg(shown.alias("shown")).select("conv_id", "shown", F.greatest(F.col("n") - 3, F.lit(0)).alias("more"))


def convs(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


_POS = V.PACKS[0].positives


def _so_far(t: str) -> str:
    return f"max(contains(text, '{t}')::INT) OVER w"


@query(f"WITH s AS (SELECT conv_id, turn, ({' + '.join(_so_far(t) for t in _POS)})::DOUBLE AS e FROM conversations WHERE role = 'user' WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT conv_id, turn, round_even(e / (e + 2), 4) AS score FROM s")
def conversation_scores(spark, sf_dir):
    return sessions.score_trace(convs(spark, sf_dir), _POS)


@query("WITH j AS (SELECT conv_id, turn, string_agg(coalesce(text, ''), '' ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t FROM conversations WHERE role = 'user'), s AS (SELECT *, (" + " + ".join(f"contains(t, '{x}')::INT" for x in V.SPANNING) + ")::DOUBLE AS e FROM j) SELECT conv_id, turn, round_even(e / (e + 2), 4) AS score FROM s")
def conversation_scores_joined(spark, sf_dir):
    """Scores of all that was said, run together: terms may begin in one utterance and end in another."""
    return sessions.score_trace(convs(spark, sf_dir), V.SPANNING, joint="")


_ANSWERED = f"""
q AS (SELECT conv_id, turn, CASE {' '.join(f"WHEN {terms_sql('text', ws)} THEN '{n}'" for n, ws in V.ASKED)} END AS intent FROM conversations WHERE role = 'user'),
n AS (SELECT conv_id, count(*) AS n, min(role) AS r, substr(min(text), 1, 10) AS x FROM conversations GROUP BY conv_id HAVING conv_id % 7 > 0),
v AS (SELECT *, CASE conv_id % 4 WHEN 0 THEN 'COVERED_LOCKED' WHEN 1 THEN 'UNCOVERED' ELSE 'COVERED' END AS status FROM n),
w AS (SELECT *, status = 'COVERED' AS open, CASE intent WHEN 'risk' THEN ['{chat.RISK}' || CASE WHEN n > 5 THEN '高' ELSE '低' END] WHEN 'type' THEN [r] WHEN 'stage' THEN ['turn ' || n || CASE WHEN n % 2 = 0 THEN '' ELSE chr(10) || chr(10) || 'odd' END]
 WHEN 'actions' THEN CASE WHEN n > 3 THEN ['1. a', '2. b'] END WHEN 'cases' THEN ['・[165 ' || q.conv_id || '] ' || x] WHEN 'legal' THEN CASE WHEN n % 3 > 0 THEN ['・Act Art. ' || n || '（2024-01-01）'] END END AS held FROM q LEFT JOIN v USING (conv_id))"""


@query(f"""WITH {_ANSWERED} SELECT conv_id, turn, intent,
CASE WHEN intent IS NULL THEN 'say' WHEN open AND held IS NOT NULL THEN CASE WHEN intent = 'risk' THEN 'risk' ELSE 'verdict' END WHEN status = 'COVERED_LOCKED' THEN 'locked' ELSE 'say' END AS kind,
CASE WHEN intent IS NULL THEN ['{chat.ONLY_THIS}'] WHEN open AND held IS NOT NULL THEN held WHEN status = 'COVERED_LOCKED' THEN ['locked ' || conv_id] ELSE ['{chat.MISSING}'] END AS lines FROM w""")
def followup_answers(spark, sf_dir):
    """What each user turn asks for, answered from a stored decision of its conversation."""
    c = convs(spark, sf_dir)
    asked = c.filter("role = 'user'").select("conv_id", "turn", chat.follow_up(F.col("text"), V.ASKED).alias("intent"))
    n = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.min("role").alias("r"), F.substring(F.min("text"), 1, 10).alias("x")).filter("conv_id % 7 > 0")
    status = F.when(F.col("conv_id") % 4 == 0, "COVERED_LOCKED").when(F.col("conv_id") % 4 == 1, "UNCOVERED").otherwise("COVERED")
    pair = lambda k, t: F.struct(F.lit(k).alias("order"), F.lit(t).alias("text"))
    decided = n.select(
        "conv_id", status.alias("status"), F.when(status == "COVERED", F.when(F.col("n") > 5, "HIGH").otherwise("LOW")).alias("risk"), F.col("r").alias("scam_type"),
        F.concat(F.lit("turn "), F.col("n").cast("string")).alias("stage"), F.when(F.col("n") % 2 == 0, "").otherwise("odd").alias("explanation"),
        F.when(F.col("n") > 3, F.array(pair(2, "b"), pair(1, "a"))).alias("actions"),
        F.array(F.struct(F.lit("165").alias("source"), F.col("conv_id").cast("string").alias("case_id"), F.col("x").alias("excerpt"))).alias("cases"),
        F.when(F.col("n") % 3 > 0, F.array(F.struct(F.lit("Act").alias("title"), F.concat(F.lit("Art. "), F.col("n").cast("string")).alias("article"), F.lit("2024-01-01").alias("version_date")))).alias("legal"),
        F.concat(F.lit("locked "), F.col("conv_id").cast("string")).alias("locked_notice"),
    )
    return chat.answers(asked, decided)


@query(f"SELECT conv_id, min(turn) FILTER ({terms_sql('text', V.TACTIC)}) AS first_turn FROM conversations WHERE role = 'user' GROUP BY conv_id")
def first_distress_turn(spark, sf_dir):
    return sessions.first_distress(convs(spark, sf_dir), V.TACTIC)


@query("SELECT conv_id, turn, CASE " + " ".join(f"WHEN {terms_sql('text', ts)} THEN '{n}'" for n, ts in V.INTENTS) + " END AS intent FROM conversations WHERE role = 'user'")
def followup_intent(spark, sf_dir):
    return sessions.intents(convs(spark, sf_dir), V.INTENTS)


@query("SELECT conv_id, turn, role, coalesce(role <> lag(role) OVER (PARTITION BY conv_id ORDER BY turn), true) AS changed FROM conversations")
def speaker_change(spark, sf_dir):
    return sessions.speaker_changes(convs(spark, sf_dir))


_SLOT = "s AS (SELECT conv_id, count(*) AS answers, " + ", ".join(f"bool_or({terms_sql('text', ts)}) AS s_{n}" for n, ts in V.SLOTS.items()) + ", (" + " + ".join(f"max(contains(text, '{t}')::INT)" for t in _POS) + ")::DOUBLE AS e FROM conversations WHERE role = 'user' GROUP BY conv_id)"
_LIST = lambda neg: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {neg} s_{n} THEN '{n}' END" for n in V.SLOTS) + "], lambda x: x IS NOT NULL), ',')"


@query(f"WITH {_SLOT} SELECT conv_id, answers, CASE WHEN answers > 3 THEN 'DONE' ELSE 'COLLECTING' END AS phase, {_LIST('')} AS filled, {_LIST('NOT')} AS open, round_even(e / (e + 2), 4) AS score FROM s")
def session_state(spark, sf_dir):
    return sessions.session_state(convs(spark, sf_dir), V.SLOTS, 3, _POS)


def judged(spark, sf_dir):
    """Truth and prediction on the labelled rows: quality against a marks-and-symbols rule."""
    lab = table(spark, sf_dir, "labels").join(docs(spark, sf_dir), "doc_id")
    return lab.select("doc_id", F.col("quality").cast("string").alias("y"), F.when(F.col("text").rlike(r"!!|###|\| "), "0").otherwise("1").alias("p"), (1 - F.col("toxic")).cast("string").alias("b"))


_J = "j AS (SELECT doc_id, quality::VARCHAR AS y, CASE WHEN regexp_matches(text, '!!|###|\\| ') THEN '0' ELSE '1' END AS p, (1 - toxic)::VARCHAR AS b FROM labels JOIN documents USING (doc_id))"
_PL = f"{_J}, u AS (SELECT DISTINCT l FROM (SELECT y AS l FROM j UNION ALL SELECT p FROM j)), c AS (SELECT l AS label, (SELECT count(*) FROM j WHERE y = l) AS support, (SELECT count(*) FROM j WHERE p = l) AS predicted, (SELECT count(*) FROM j WHERE y = l AND p = l) AS hit FROM u), pl AS (SELECT label, support, coalesce(hit / nullif(predicted, 0)::DOUBLE, 0) AS pr, coalesce(hit / nullif(support, 0)::DOUBLE, 0) AS re FROM c)"


@query(f"WITH {_J} SELECT y AS y_true, p AS y_pred, count(*) AS n FROM j GROUP BY y, p")
def confusion_matrix(spark, sf_dir):
    return E.confusion(judged(spark, sf_dir), "y", "p")


@query(f"WITH {_PL} SELECT label, support, round(pr, 6) AS precision, round(re, 6) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 6) AS f1 FROM pl")
def per_label_prf(spark, sf_dir):
    return E.per_label(judged(spark, sf_dir), "y", "p")


@query(f"WITH {_PL} SELECT round(avg(coalesce(2 * pr * re / nullif(pr + re, 0), 0)) FILTER (support > 0), 5) AS macro_f1, (SELECT round(avg((y = p)::INT), 6) FROM j) AS accuracy FROM pl")
def macro_f1(spark, sf_dir):
    return E.macro_f1(judged(spark, sf_dir), "y", "p")


@query(f"WITH {_J}, n AS (SELECT count(*) AS n, sum((y = b)::INT) AS same FROM j), c AS (SELECT sum(l * r)::DOUBLE AS c FROM (SELECT y AS k, count(*) AS l FROM j GROUP BY y) JOIN (SELECT b AS k, count(*) AS r FROM j GROUP BY b) USING (k)) SELECT n, round((same / n::DOUBLE - c / (n * n)) / (1 - c / (n * n)), 6) AS kappa FROM n, c")
def cohen_kappa(spark, sf_dir):
    return E.cohen_kappa(judged(spark, sf_dir), "y", "b")


@query(f"SELECT round(sum(levenshtein(a, b)) / sum(length(a))::DOUBLE, 6) AS corpus_cer FROM ({HEARD})")
def corpus_cer(spark, sf_dir):
    """As cer, all edits over all characters."""
    ship(spark)
    return E.corpus_cer(heard_turns(spark, sf_dir), "a", "b")


@query()
def corpus_cer_whole(spark, sf_dir):
    """As cer_whole, all edits over all characters."""
    ship(spark)
    return E.corpus_cer(heard(table(spark, sf_dir, "documents").select("doc_id", "text")), "a", "b")


@query("SELECT event_type, value AS p95 FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value) AS plc, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE plc = greatest(1, least(n, round_even(0.95 * n, 0)::BIGINT))")
def latency_p95(spark, sf_dir):
    return E.latency_p95(table(spark, sf_dir, "events"), "value", ["event_type"])


@query("SELECT event_type, round(CASE WHEN a > 0 THEN (b - a) / a ELSE 0 END, 6) AS gain FROM (SELECT event_type, avg(value) FILTER (event_id % 2 = 0) AS a, avg(value) FILTER (event_id % 2 = 1) AS b FROM events GROUP BY event_type)")
def relative_gain(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    by = e.groupBy("event_type").agg(F.avg(F.when(F.col("event_id") % 2 == 0, F.col("value"))).alias("a"), F.avg(F.when(F.col("event_id") % 2 == 1, F.col("value"))).alias("b"))
    return by.select("event_type", F.round(E.relative_gain(F.col("a"), F.col("b")), 6).alias("gain"))


@query("SELECT event_type AS metric, v AS value, CASE event_type WHEN 'click' THEN 0.75 WHEN 'view' THEN 1.0 ELSE 0.0 END AS threshold, CASE event_type WHEN 'view' THEN 'le' ELSE 'ge' END AS direction, CASE event_type WHEN 'click' THEN v >= 0.75 WHEN 'view' THEN v <= 1.0 ELSE v >= 0 END AS passed FROM (SELECT event_type, round(avg(value), 6) AS v FROM events GROUP BY event_type)")
def score_table(spark, sf_dir):
    values = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("metric")).agg(F.round(F.avg("value"), 6).alias("value"))
    limits = spark.createDataFrame([("click", 0.75, "ge"), ("view", 1.0, "le")], "metric string, threshold double, direction string")
    return E.score_table(values, limits)


@query(f"WITH {ROUTE} SELECT count(*) AS total, count(*) FILTER ((prim = 'a') = (lang = 'en')) AS hits, count(*) >= 20 AND count(*) FILTER ((prim = 'a') = (lang = 'en')) >= 0.85 * count(*) AS admitted FROM rt JOIN documents USING (doc_id) WHERE prim IS NOT NULL")
def admission_hits(spark, sf_dir):
    r = routed(spark, sf_dir).filter("primary is not null").join(docs(spark, sf_dir), "doc_id")
    hit = F.count_if((F.col("primary") == "a") == (F.col("lang") == "en"))
    return r.agg(F.count(F.lit(1)).alias("total"), hit.alias("hits")).withColumn("admitted", (F.col("total") >= 20) & (F.col("hits") >= 0.85 * F.col("total")))


@query("SELECT user_id, round(sum(value), 4) AS elapsed, round(coalesce(sum(value) FILTER (starts_with(event_type, 'p')), 0), 4) AS shell FROM events GROUP BY user_id")
def trace_elapsed(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    top = F.coalesce(F.sum(F.when(F.col("event_type").startswith("p"), F.col("value"))), F.lit(0.0))
    return e.groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("elapsed"), F.round(top, 4).alias("shell"))


@query("SELECT lang AS label, n, round(sum(n) OVER (ORDER BY n DESC, lang) / sum(n) OVER ()::DOUBLE, 6) AS cumulative, row_number() OVER (ORDER BY n DESC, lang) AS place FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)")
def label_coverage(spark, sf_dir):
    return A.label_coverage(docs(spark, sf_dir), "lang")


@query("SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'es') AS es FROM documents GROUP BY source")
def crosstab(spark, sf_dir):
    return A.crosstab(docs(spark, sf_dir), "source", F.col("lang"), ["en", "fr", "de", "es"])


@query("SELECT count(*) AS n, round(median(a / l), 6) AS median_position, round(avg((a / l <= 0.2)::INT), 6) AS in_first_fifth, round(avg((a < b)::INT) FILTER (b > 0), 6) AS before_other FROM (SELECT instr(text, 'thing')::DOUBLE AS a, instr(text, 'tion') AS b, length(text) AS l FROM documents) WHERE a > 0")
def keyword_position(spark, sf_dir):
    return A.positions(docs(spark, sf_dir), "text", "thing", "tion")


_TERMS = ["thing", "###", "!!", "License", "eau"]
_RATES = "t AS (SELECT unnest(['thing', '###', '!!', 'License', 'eau']) AS term), r AS (SELECT term, avg(contains(text, term)::INT) FILTER (quality = 1) AS a, avg(contains(text, term)::INT) FILTER (quality = 0) AS b FROM t, labels JOIN documents USING (doc_id) GROUP BY term)"


def _rates(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").join(docs(spark, sf_dir), "doc_id")
    return A.term_rates(lab, "text", F.col("quality") == 1, _TERMS)


@query(f"WITH {_RATES} SELECT term, round(a, 6) AS pos_rate, round(b, 6) AS neg_rate, round(a - b, 6) AS discrimination FROM r")
def term_discrimination(spark, sf_dir):
    return _rates(spark, sf_dir).select("term", "pos_rate", "neg_rate", "discrimination")


@query(f"WITH {_RATES} SELECT term, round(CASE WHEN b > 0 THEN a / b END, 6) AS lift FROM r")
def term_lift(spark, sf_dir):
    return _rates(spark, sf_dir).select("term", "lift")


@query(f"WITH {SCORES}, x AS (SELECT score, lang = 'en' AS p FROM sc JOIN documents USING (doc_id) WHERE module = 'a') SELECT cut, round(avg((score >= cut)::INT) FILTER (p), 6) AS accepted, round(avg((score >= cut)::INT) FILTER (NOT p), 6) AS false_accepted FROM x, unnest([0.35::DOUBLE, 0.45::DOUBLE, 0.55::DOUBLE]) AS c(cut) GROUP BY cut")
def threshold_sweep(spark, sf_dir):
    return A.threshold_sweep(docs(spark, sf_dir), F.round(V.PACKS[0].score(F.col("text")), 6), F.col("lang") == "en", [0.35, 0.45, 0.55])


@query("WITH q AS (SELECT date_trunc('quarter', o_orderdate)::DATE AS quarter, count(*) AS n, avg((o_orderpriority = '1-URGENT')::INT) AS raw FROM orders GROUP BY 1) SELECT quarter, n, round(raw, 6) AS share, round(raw - lag(raw) OVER (ORDER BY quarter), 6) AS change FROM q")
def quarterly_share(spark, sf_dir):
    return A.quarterly_share(table(spark, sf_dir, "orders"), "o_orderdate", F.col("o_orderpriority") == "1-URGENT")


@query("WITH s AS (SELECT contains(text, 'thing') AS a, contains(text, 'tion') AS b FROM documents) SELECT count(*) FILTER (a) AS n_a, count(*) FILTER (b) AS n_b, count(*) FILTER (a AND b) AS n_both, round(count(*) FILTER (a AND b) / nullif(count(*) FILTER (a), 0)::DOUBLE, 6) AS share_of_a, round(count(*) FILTER (a AND b) / nullif(count(*) FILTER (b), 0)::DOUBLE, 6) AS share_of_b FROM s")
def segment_overlap(spark, sf_dir):
    return A.segment_overlap(docs(spark, sf_dir), F.contains("text", F.lit("thing")), F.contains("text", F.lit("tion")))


_FLAGS = list(V.MATRIX.items())


@query("WITH f AS (SELECT " + ", ".join(f"regexp_matches(text, '{p}') AS {n}" for n, p in _FLAGS) + " FROM documents) " + " UNION ALL ".join(f"SELECT '{a}' AS given, '{b}' AS then, count(*) FILTER ({a}) AS n, round(count(*) FILTER ({a} AND {b}) / nullif(count(*) FILTER ({a}), 0)::DOUBLE, 6) AS rate FROM f" for a, _ in _FLAGS for b, _ in _FLAGS if a != b))
def stage_cooccurrence(spark, sf_dir):
    return A.cooccurrence(docs(spark, sf_dir), {n: F.col("text").rlike(p) for n, p in V.MATRIX.items()})
