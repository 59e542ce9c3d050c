"""Corpus, text, masking and facet queries on the standard tables."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from sievewright.functions import masking as M
from sievewright.functions import text as T
from sievewright.operators import corpus as C
from sievewright.plans import vocab as V
from sievewright.plans.registry import query
from sievewright.session import ship, table
from sievewright.sources import uploads


CLEAN = r"trim(regexp_replace(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '\s+', ' ', 'g'))"


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def terms_sql(column: str, terms, low: bool = False) -> str:
    hay = f"lower({column})" if low else column
    return "(" + " OR ".join(f"contains({hay}, '{(t.lower() if low else t)}')" for t in terms) + ")"


def mask_sql(column: str) -> str:
    """The masking rules for a regex engine without look-around: what must not touch a match is
    matched, kept, and looked at twice, so that neighbours can share it."""
    out = column
    for _, pattern, placeholder in (*M.RULES, M.LONG_RUN):
        p = pattern.replace(r"[\w.+-]", r"[\p{L}\p{N}_.+-]").replace(r"[\w-]", r"[\p{L}\p{N}_-]").replace(r"[\w.-]", r"[\p{L}\p{N}_.-]")
        before = after = ""
        for look, kept in ((r"(?<!\d)", "(^|[^0-9])"), (r"(?<![A-Za-z0-9])", "(^|[^A-Za-z0-9])")):
            if p.startswith(look):
                p, before = p[len(look):], kept
        for look, kept in ((r"(?!\d)", "([^0-9]|$)"), (r"(?![0-9])", "([^0-9]|$)"), (r"(?=[，。、\s]|$)", r"([，。、\s]|$)")):
            if p.endswith(look):
                p, after = p[: -len(look)], kept
        lead = re.search(r"\((?!\?)", p)
        if lead:  # a group: what leads up to it stays
            at = lead.start()
            p, before = p[at:], f"({p[:at]})"
            p = "(?:" + p[1:]
        new = ("\\1" if before else "") + placeholder + (f"\\{1 + bool(before)}" if after else "")
        p = before + (f"(?:{p})" if before or after else p) + after
        for _ in range(2 if before or after else 1):
            out = f"regexp_replace({out}, '{p}', '{new}', 'g')"
    return out


def facet_sql(column: str, table_: dict) -> str:
    tags = ", ".join(f"CASE WHEN {terms_sql(column, ws, True)} THEN '{v}' END" for v, ws in table_.items())
    return f"list_filter([{tags}], lambda x: x IS NOT NULL)"


@query("SELECT doc_id::VARCHAR AS case_id, coalesce(text, '') AS text, coalesce(lang, '') AS label, '' AS date, '' AS county, '' AS county_id, '165' AS source FROM documents")
def normalise_corpus(spark, sf_dir):
    return C.normalise(docs(spark, sf_dir), {"case_id": "doc_id", "text": "text", "label": "lang"}, "165")


@query("SELECT doc_id, source, lang, n_chars FROM documents")
def scan_parquet(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", "source", "lang", "n_chars")


@query("SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS source FROM documents")
def scan_jsonl(spark, sf_dir):
    """Round trip through JSON lines, with a line separator inside the text."""
    from sievewright.sources import jsonl

    path = jsonl.write(docs(spark, sf_dir).select("doc_id", "text", "source"), stash_path(spark))
    return jsonl.read(spark, path, "doc_id long, text string, source string")


def stash_path(spark):
    from sievewright.session import passing

    return passing(spark, "jsonl") + "/rows"


@query("SELECT doc_id, sha256(text) AS content_key, substr(sha256(text), 1, 32) || '.txt' AS path FROM documents")
def content_hash(spark, sf_dir):
    key = F.sha2("text", 256)
    return docs(spark, sf_dir).select("doc_id", key.alias("content_key"), F.concat(F.substring(key, 1, 32), F.lit(".txt")).alias("path"))


@query("SELECT substr(sha256(coalesce(text, '')), 1, 32) || '.txt' AS name, min('d' || doc_id) AS path, any_value(strlen(coalesce(text, '')))::BIGINT AS length FROM documents GROUP BY coalesce(text, '')")
def stored_uploads(spark, sf_dir):
    """Texts as files of bytes, each content once, under the name that it has."""
    files = docs(spark, sf_dir).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return uploads.named(files, ".txt").select("name", "path", F.octet_length("content").cast("long").alias("length"))


@query("SELECT doc_id AS qi, list(label ORDER BY label) AS relevant FROM (SELECT doc_id, unnest(['quality', 'toxic']) AS label, unnest([quality, toxic]) AS v FROM labels) WHERE v = 1 GROUP BY doc_id")
def judgements_unpivot(spark, sf_dir):
    """Judgements kept as a JSON object of 'query|item' keys, unfolded and grouped."""
    lab = table(spark, sf_dir, "labels")
    packed = lab.select(F.to_json(F.create_map(F.concat("doc_id", F.lit("|quality")), F.col("quality") == 1, F.concat("doc_id", F.lit("|toxic")), F.col("toxic") == 1)).alias("j"))
    long = packed.select(F.explode(F.from_json("j", "map<string,boolean>")).alias("key", "yes")).filter("yes")
    part = F.split("key", r"\|", 2)
    return long.select(part[0].cast("long").alias("qi"), part[1].alias("item")).groupBy("qi").agg(F.array_sort(F.collect_list("item")).alias("relevant"))


@query("SELECT vec_id FROM embeddings WHERE len(embedding) = 64 AND label % 2 = 0")
def index_compat_filter(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("model", F.when(F.col("label") % 2 == 0, "m0").otherwise("m1"))
    return C.compatible_index(e, "m0", 64).select("vec_id")


@query("SELECT doc_id, source FROM documents WHERE source <> 'src3'")
def remove_source(spark, sf_dir):
    return C.remove_source(docs(spark, sf_dir), "src3").select("doc_id", "source")


@query(r"SELECT page_id, replace(replace(regexp_replace(url, '\s+', '', 'g'), '（', '('), '）', ')') AS label FROM pages")
def norm_label(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.norm_label(F.col("url")).alias("label"))


@query(r"SELECT doc_id, trim(replace(replace(text, chr(10), ''), chr(9), '')) AS label FROM documents")
def norm_label_nfkc(spark, sf_dir):
    ship(spark)
    return docs(spark, sf_dir).select("doc_id", T.norm_label_nfkc(F.col("text")).alias("label"))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '\s+', ' ', 'g')) AS clean FROM documents")
def clean_text(spark, sf_dir):
    ship(spark)
    return docs(spark, sf_dir).select("doc_id", T.clean_text(F.col("text")).alias("clean"))


@query(f"SELECT doc_id, substr(m, 1, 120) AS short, CASE WHEN length(m) > 220 THEN substr(m, 1, 220) || '…' ELSE m END AS judged FROM (SELECT doc_id, {mask_sql('text')} AS m FROM documents)")
def excerpt(spark, sf_dir):
    """Masked as a whole, then cut."""
    m = M.mask_native(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", m.alias("m")).select("doc_id", T.excerpt(F.col("m")).alias("short"), T.excerpt(F.col("m"), 220, "…").alias("judged"))


@query("SELECT page_id, array_to_string(list_filter([url, coalesce(html, ''), CASE WHEN page_id % 2 = 0 THEN ' ' ELSE 'end' END], lambda x: trim(x) <> ''), chr(10)) AS combined FROM pages")
def combine_blocks(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", T.join_non_blank([F.col("url"), F.col("html"), F.when(F.col("page_id") % 2 == 0, " ").otherwise("end")], "\n").alias("combined"))


@query(r"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '\s+', ' ', 'g'), '.'), lambda x: trim(x)), lambda x: x <> '') AS a FROM documents)
SELECT doc_id, CASE WHEN len(a) > 0 THEN array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i), '.') || '.' ELSE '' END AS tidy FROM s""")
def dedup_sentences(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.dedup_sentences(F.col("text"), ".").alias("tidy"))


@query("SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM pages")
def html_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.html_escape(F.col("html")).alias("escaped"))


@query("""SELECT page_id, regexp_replace(regexp_replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '(https?)', '<mark class="link">\\1</mark>', 'g'), '([0-9]{4,})', '<mark class="num">\\1</mark>', 'g') AS marked FROM pages""")
def highlight(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.highlight(F.col("html"), [("link", "https?"), ("num", "[0-9]{4,}")]).alias("marked"))


@query("SELECT doc_id FROM documents WHERE replace(lang, ' ', '') IN ('en', 'fr')")
def label_in(spark, sf_dir):
    return C.label_in(docs(spark, sf_dir), "lang", ["en", "fr"]).select("doc_id")


@query("SELECT doc_id, source FROM documents WHERE contains(lower(source), 'src1') AND NOT contains(lower(source), 'src11')")
def label_substring_filter(spark, sf_dir):
    return C.label_contains(docs(spark, sf_dir), "source", ["SRC1"], ["src11"]).select("doc_id", "source")


@query(f"SELECT doc_id FROM documents WHERE {terms_sql('text', V.PLATFORMS, True)}")
def any_term_filter(spark, sf_dir):
    return docs(spark, sf_dir).filter(T.any_term(F.col("text"), V.PLATFORMS, False)).select("doc_id")


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '(^|[^A-Za-z])(that|MIT)($|[^A-Za-z])')")
def word_boundary_filter(spark, sf_dir):
    return docs(spark, sf_dir).filter(T.bounded_term(F.col("text"), ["that", "MIT"])).select("doc_id")


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)license|token')")
def regex_filter(spark, sf_dir):
    return docs(spark, sf_dir).filter(F.col("text").rlike("(?i)license|token")).select("doc_id")


@query("SELECT doc_id FROM documents WHERE NOT regexp_matches(text, 'trash|idiot')")
def regex_exclude(spark, sf_dir):
    return docs(spark, sf_dir).filter(~F.col("text").rlike("trash|idiot")).select("doc_id")


@query(r"SELECT doc_id FROM documents WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 20")
def min_chars(spark, sf_dir):
    return docs(spark, sf_dir).filter(F.char_length(T.strip(F.col("text"))) >= 20).select("doc_id")


def faceted(spark, sf_dir):
    return C.derive_facets(docs(spark, sf_dir), "text", V.TABLES)


_CAT, _CHAN = facet_sql("text", V.TABLES["category"]), facet_sql("text", V.TABLES["channel"])


@query(f"SELECT doc_id, {_CAT} AS category, {_CHAN} AS channel FROM documents")
def derive_facets(spark, sf_dir):
    f = faceted(spark, sf_dir)
    return f.select("doc_id", F.col("facets")["category"].alias("category"), F.col("facets")["channel"].alias("channel"))


@query(f"SELECT doc_id FROM documents WHERE len(list_intersect({_CAT}, ['legal', 'secret'])) > 0 AND len(list_intersect({_CHAN}, ['mail'])) > 0")
def facet_filter(spark, sf_dir):
    wanted = F.create_map(F.lit("category"), F.array(F.lit("legal"), F.lit("secret")), F.lit("channel"), F.array(F.lit("mail")))
    return faceted(spark, sf_dir).filter(C.facet_match(F.col("facets"), wanted)).select("doc_id")


_PARSED = f"list_concat({facet_sql('q', V.TABLES['channel'])}, CASE WHEN contains(q, 'Online') THEN ['mail', 'web'] ELSE [] END)"


@query(f"""WITH t AS (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'Online ' ELSE '' END || text || ' www' AS q FROM benchmark), p AS (SELECT item_id, {facet_sql('q', V.TABLES['category'])} AS cat, {_PARSED} AS chan FROM t)
SELECT item_id, CASE WHEN len(cat) > 0 THEN array_to_string(cat, ',') END AS category, array_to_string(list_filter(chan, lambda x, i: list_position(chan, x) = i), ',') AS channel FROM p""")
def parse_query(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.when(F.col("item_id") % 2 == 0, "Online ").otherwise(""), "text", F.lit(" www")).alias("q"))
    parsed = b.withColumn("f", C.parse_query(F.col("q"), V.TABLES, V.GROUPS))
    return parsed.select("item_id", F.array_join(F.try_element_at("f", F.lit("category")), ",").alias("category"), F.array_join(F.try_element_at("f", F.lit("channel")), ",").alias("channel"))


@query(r"SELECT doc_id, code, regexp_full_match(code, '[A-Z]{3}-[0-9]{2,}') AS ok FROM (SELECT doc_id, upper(source) || '-' || doc_id AS c0, CASE WHEN doc_id % 2 = 0 THEN 'SRC-' || doc_id ELSE upper(source) || '-' || doc_id END AS code FROM documents)")
def check_code(spark, sf_dir):
    code = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("SRC-"), "doc_id")).otherwise(F.concat(F.upper("source"), F.lit("-"), "doc_id"))
    return docs(spark, sf_dir).select("doc_id", code.alias("code")).withColumn("ok", F.col("code").rlike(r"^[A-Z]{3}-[0-9]{2,}\z"))


@query(f"SELECT DISTINCT v AS value FROM (SELECT unnest({_CAT}) AS v FROM documents) WHERE v NOT IN ('junk', 'legal')")
def validate_vocab(spark, sf_dir):
    return C.unknown_values(faceted(spark, sf_dir), "category", ["junk", "legal"])


@query(f"""WITH u AS (SELECT 'category' AS facet, unnest({_CAT}) AS v FROM documents UNION ALL SELECT 'channel', unnest({_CHAN}) FROM documents)
SELECT facet, list(DISTINCT v ORDER BY v) AS used, list_filter(CASE facet WHEN 'category' THEN ['junk', 'legal', 'secret'] ELSE ['mail', 'phone', 'web'] END, lambda x: NOT list_contains(list(DISTINCT v), x)) AS unused FROM u GROUP BY facet""")
def facet_coverage(spark, sf_dir):
    return C.facet_coverage(faceted(spark, sf_dir), V.VOCABULARY)


@query(f"SELECT DISTINCT unnest({_CHAN}) AS value FROM documents")
def facet_known_values(spark, sf_dir):
    return C.known_values(faceted(spark, sf_dir), "channel")


@query("SELECT count(*) AS cases, count(DISTINCT nullif(lang, '')) AS labels, count(DISTINCT nullif(source, '')) AS counties FROM documents")
def corpus_stats(spark, sf_dir):
    return C.stats(docs(spark, sf_dir), "lang", "source")


_P = terms_sql("text", V.PLATFORMS, True)


@query(f"SELECT count(*) AS scanned, count(*) FILTER (lang IN ('en', 'fr')) AS total, count(*) FILTER (lang IN ('en', 'fr') AND {_P}) AS platform, count(DISTINCT (source, doc_id % 97)) FILTER (lang IN ('en', 'fr') AND {_P}) AS written FROM documents")
def subset_funnel(spark, sf_dir):
    steps = [("total", F.col("lang").isin("en", "fr")), ("platform", T.any_term(F.col("text"), V.PLATFORMS, False))]
    return C.funnel(docs(spark, sf_dir), steps, [F.col("source"), F.col("doc_id") % 97], [F.col("doc_id")])


_E = "regexp_matches(text, '(?i)license|token|thing')"


@query(f"""SELECT count(*) AS scanned, count(*) FILTER ({_E}) AS platform, count(*) FILTER ({_E} AND lang = 'en') AS tactic, count(*) FILTER ({_E} AND lang = 'en' AND NOT regexp_matches(text, 'trash|idiot')) AS allowed,
count(DISTINCT substr(nullif({CLEAN}, ''), 1, 120)) FILTER ({_E} AND lang = 'en' AND NOT regexp_matches(text, 'trash|idiot')) AS written FROM documents""")
def subset_funnel_e(spark, sf_dir):
    t = F.col("text")
    steps = [("platform", t.rlike("(?i)license|token|thing")), ("tactic", F.col("lang") == "en"), ("allowed", ~t.rlike("trash|idiot"))]
    ship(spark)
    return C.funnel(docs(spark, sf_dir).withColumn("clean", T.clean_text(t)), steps, [F.nullif(F.substring("clean", 1, 120), F.lit(""))], [F.col("doc_id")])


@query("SELECT min(doc_id) AS doc_id, doc_id % 500 AS case_id FROM documents GROUP BY doc_id % 500")
def dedup_id(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", (F.col("doc_id") % 500).alias("case_id"))
    return C.first_wins(d, [F.col("case_id")], [F.col("doc_id")])


@query("SELECT min(doc_id) AS doc_id, coalesce(source, '165') AS source, doc_id % 7 AS case_id FROM documents GROUP BY 2, 3")
def dedup_source_id(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", F.coalesce("source", F.lit("165")).alias("source"), (F.col("doc_id") % 7).alias("case_id"))
    return C.first_wins(d, [F.col("source"), F.col("case_id")], [F.col("doc_id")])


@query(f"SELECT min(doc_id) AS doc_id, substr(c, 1, 120) AS head FROM (SELECT doc_id, {CLEAN} AS c FROM documents) WHERE c <> '' GROUP BY substr(c, 1, 120)")
def dedup_prefix(spark, sf_dir):
    """The first document of each beginning of the cleaned text, which is that rule's key."""
    ship(spark)
    d = docs(spark, sf_dir).select("doc_id", T.clean_text(F.col("text")).alias("clean")).filter("clean <> ''").select("doc_id", F.substring("clean", 1, 120).alias("head"))
    return d.groupBy("head").agg(F.min("doc_id").alias("doc_id"))


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (ORDER BY doc_id) AS pos FROM documents WHERE contains(text, 'thing')) WHERE pos <= 25")
def subset_limit(spark, sf_dir):
    return docs(spark, sf_dir).filter(F.col("text").contains("thing")).orderBy("doc_id").limit(25).select("doc_id", "source")


@query(f"SELECT doc_id, {mask_sql('text')} AS masked FROM documents")
def deid_mask(spark, sf_dir):
    """All rules but those of amounts, by the native chain."""
    return docs(spark, sf_dir).select("doc_id", M.mask_native(F.col("text")).alias("masked"))


@query()
def deid_mask_full(spark, sf_dir):
    """All rules with redactions and amount ranges."""
    ship(spark)
    return docs(spark, sf_dir).select("doc_id", M.mask_struct(F.col("text")).alias("m")).select("doc_id", "m.text", "m.redactions", "m.deid_version")


#: Kinds that a text holds by its own look, before any rule has changed it.
PLAIN = {"email": r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+", "url": r"https?://[^\s，。、）)]+", "credit_card": r"(^|[^0-9])([0-9]{4}[-\s]?){3}[0-9]{4}([^0-9]|$)"}
_E, _U, _C = PLAIN.values()
_LEFT = f"regexp_replace(regexp_replace(text, '{_E}', '[EMAIL]', 'g'), '{_U}', '[URL]', 'g')"


@query(f"""WITH k AS (SELECT regexp_matches(text, '{_E}')::INT AS e, regexp_matches(text, '{_U}')::INT AS u, regexp_matches(text, '{_C}')::INT AS c,
regexp_matches(regexp_replace(text, '{_E}', '[EMAIL]', 'g'), '{_U}')::INT AS fu, regexp_matches({_LEFT}, '{_C}')::INT AS fc FROM documents)
SELECT round(avg((e + u * fu + c * fc) / (e + u + c)::DOUBLE), 6) AS recall, count(*) AS n FROM k WHERE e + u + c > 0""")
def deid_recall(spark, sf_dir):
    """Mean share of the kinds that a text holds which its masking finds, over the texts that hold any."""
    ship(spark)
    expected = F.filter(F.array(*[F.when(F.col("text").rlike(p), F.lit(k)) for k, p in PLAIN.items()]), lambda k: k.isNotNull())
    d = docs(spark, sf_dir).select("text", expected.alias("expected")).filter(F.size("expected") > 0).withColumn("found", M.found_kinds(F.col("text")))
    return d.agg(F.round(F.avg(F.size(F.array_intersect("expected", "found")) / F.size("expected")), 6).alias("recall"), F.count(F.lit(1)).alias("n"))


def bucket_sql(v: str) -> str:
    return "CASE " + " ".join(f"WHEN {v} < {c} THEN '{n}'" for c, n in M.BUCKETS) + f" ELSE '{M.TOP_BUCKET}' END"


@query(f"SELECT o_orderkey, {bucket_sql('o_totalprice')} AS bucket FROM orders")
def amount_bucket(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", M.amount_bucket(F.col("o_totalprice")).alias("bucket"))


@query("SELECT item_id, len(list_distinct(g)) AS n, list_sort(list_distinct(g)) AS grams FROM (SELECT item_id, list_transform(range(1, length(text)), lambda i: c[i] || c[i + 1]) AS g FROM (SELECT *, string_split(text, '') AS c FROM benchmark))")
def char_bigrams(spark, sf_dir):
    g = T.char_grams(F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(g).cast("long").alias("n"), F.sort_array(g).alias("grams"))


_TOK = "list_filter(regexp_split_to_array(lower(text), '[^A-Za-z0-9一-鿿]+'), lambda s: s <> '')"


@query(f"SELECT doc_id, {_TOK} AS tokens FROM documents")
def tokenize(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.tokens(F.col("text")).alias("tokens"))


#: What a listener makes of a text: letters taken for others, left out and put in, anywhere in it.
MISHEARD = (("tion", "cion"), ("hea", "he"), ("st ", "sst "), ("(?i)and", "an"), ("[0-9]{3}", "#"), ("er[.,]", "or "))


def heard(df):
    """Every whole text (``a``) and what is heard of it (``b``)."""
    out = F.coalesce("text", F.lit(""))
    df = df.withColumn("a", out)
    for said, taken in MISHEARD:
        out = F.regexp_replace(out, said, taken)
    return df.withColumn("b", out)


def heard_turns(spark, sf_dir):
    """Turns of conversations, with a question mark for each character beyond ASCII."""
    return heard(table(spark, sf_dir, "conversations").withColumn("text", F.regexp_replace("text", r"[^\x00-\x7F]", "?")))


def _heard_sql(a: str = "a") -> str:
    for said, taken in MISHEARD:
        a = f"regexp_replace({a}, '{said}', '{taken}', 'g')"
    return a


#: The same in DuckDB, whose levenshtein counts bytes and takes quadratic time: hence turns, in ASCII.
HEARD = rf"SELECT *, {_heard_sql()} AS b FROM (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', '?', 'g') AS a FROM conversations)"


@query(f"SELECT conv_id, turn, CASE WHEN a <> '' THEN round(levenshtein(a, b) / length(a)::DOUBLE, 6) WHEN b <> '' THEN 1 ELSE 0 END AS cer FROM ({HEARD})")
def cer(spark, sf_dir):
    """Character error rates of whole turns against what is heard of them."""
    ship(spark)
    return heard_turns(spark, sf_dir).select("conv_id", "turn", F.round(T.cer(F.col("a"), F.col("b")), 6).alias("cer"))


@query()
def cer_whole(spark, sf_dir):
    """As cer, of all documents, whole, in any script."""
    ship(spark)
    return heard(docs(spark, sf_dir)).select("doc_id", F.round(T.cer(F.col("a"), F.col("b")), 6).alias("cer"))


@query(r"""SELECT doc_id, array_to_string(regexp_extract_all(text, '(?i)license version|license|token|version'), ',') AS found FROM documents""")
def terms_in(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.array_join(T.terms_in(F.col("text"), ["license", "license version", "token", "version"]), ",").alias("found"))


@query(r"SELECT doc_id, try_cast(nullif(regexp_extract(text, '([0-9]{1,3})\s*(?:\.|-)', 1), '') AS INTEGER) AS days FROM documents")
def extract_days(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.extract_days(F.col("text"), r"\.|-").alias("days"))


@query(r"""SELECT conv_id, 'Summarise.' || chr(10) || min(text) || chr(10) || array_to_string(list_transform(list(text ORDER BY turn)[1:3], lambda t, i: i || '. ' || substr(t, 1, 120)), chr(10)) AS prompt FROM conversations GROUP BY conv_id""")
def build_prompt(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter("turn is not null")
    # Three turns a conversation are kept before the shuffle, so no conversation becomes one row.
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    shown = c.select("conv_id", "turn", F.substring("text", 1, 120).alias("t")).withColumn("at", place).filter("at <= 3")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("at", "t"))), lambda h: F.concat(h["at"].cast("string"), F.lit(". "), h["t"]))
    first = shown.groupBy("conv_id").agg(F.array_join(lines, "\n").alias("first"))
    least = c.groupBy("conv_id").agg(F.min("text").alias("least"))
    return least.join(first, "conv_id").select("conv_id", F.concat_ws("\n", F.lit("Summarise."), "least", "first").alias("prompt"))


