"""DuckDB SQL for the operators that SQL can express."""

EXACT_DEDUP = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       coalesce(doc_id = max(doc_id) OVER w, false) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

SOURCE_MIXING = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, sha256(coalesce(text, '')))) AS ord FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, 3 * source_size AS cap, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM src
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::BIGINT AS lft,
         (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::BIGINT AS opn
  FROM weighed WINDOW b AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT *, max(CASE WHEN weight * lft <= cap * opn THEN lft::DOUBLE / opn END) OVER () AS lvl FROM levels
), targets AS (
  SELECT source, source_size, coalesce(CASE WHEN cap > weight * lvl THEN weight * lvl ELSE cap::DOUBLE END, cap::DOUBLE) AS target,
         (3 * source_size) // 32 AS most_blocks, sum(source_size) OVER ()::BIGINT // 32 AS seats,
         greatest(1, source_size // 4000000) AS shards FROM level
), s_bounds AS (
  SELECT *, least(floor(target * greatest(seats - count(*) OVER () / 2.0, 0.0) / sum(target) OVER () + 0.5)::BIGINT, most_blocks) AS low,
         least(floor(target * (seats + count(*) OVER () / 2.0 + 1) / sum(target) OVER () + 0.5)::BIGINT, most_blocks) AS high FROM targets
), s_offers AS (
  SELECT b.*, seats - sum(low) OVER () AS opn FROM s_bounds b
), s_ranked AS (
  SELECT o.source, seat, opn, row_number() OVER (ORDER BY target / (2 * seat + 1) DESC, o.source NULLS LAST, seat) AS rnk
  FROM s_offers o, unnest(range(low, high)) AS u(seat)
), quotas AS (
  SELECT o.source, o.source_size, o.target, o.shards,
         low + (SELECT count(*) FROM s_ranked r WHERE r.source IS NOT DISTINCT FROM o.source AND rnk <= r.opn) AS quota FROM s_offers o
), dealt AS (
  SELECT d.*, q.source_size, q.target, q.quota, ('0x' || substr(ord, 1, 8))::BIGINT % q.shards AS shard
  FROM sized d JOIN quotas q ON d.source IS NOT DISTINCT FROM q.source
), parts AS (
  SELECT source, shard, any_value(quota) AS quota, sum(size)::BIGINT AS shard_size FROM dealt GROUP BY source, shard
), p_bounds AS (
  SELECT *, (3 * shard_size) // 32 AS most_blocks, count(*) OVER g / 2.0 AS half, sum(shard_size) OVER g AS votes FROM parts
  WINDOW g AS (PARTITION BY source)
), p_offers AS (
  SELECT *, quota - sum(low) OVER (PARTITION BY source) AS opn FROM (
    SELECT *, coalesce(least(floor(shard_size * greatest(quota - half, 0.0) / nullif(votes, 0) + 0.5)::BIGINT, most_blocks), 0) AS low,
           coalesce(least(floor(shard_size * (quota + half + 1) / nullif(votes, 0) + 0.5)::BIGINT, most_blocks), 0) AS high FROM p_bounds)
), p_ranked AS (
  SELECT o.source, o.shard, opn, row_number() OVER (PARTITION BY o.source ORDER BY shard_size / (2 * seat + 1) DESC, o.shard, seat) AS rnk
  FROM p_offers o, unnest(range(low, high)) AS u(seat)
), blocks AS (
  SELECT o.source, o.shard, o.shard_size,
         (low + (SELECT count(*) FROM p_ranked r WHERE r.source IS NOT DISTINCT FROM o.source AND r.shard = o.shard AND rnk <= r.opn)) * 32 AS words
  FROM p_offers o
), placed AS (
  SELECT d.*, b.shard_size, b.words, coalesce(sum(size) OVER (PARTITION BY d.source, d.shard ORDER BY ord, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM dealt d JOIN blocks b ON d.source IS NOT DISTINCT FROM b.source AND d.shard = b.shard
)
SELECT doc_id, source, size, source_size, target,
       (CASE WHEN shard_size > 0 THEN words // shard_size ELSE 0 END * size
        + greatest(0, least(size, words - CASE WHEN shard_size > 0 THEN words // shard_size ELSE 0 END * shard_size - start)))::BIGINT AS taken
FROM placed
"""

QUALITY_RULES = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS k FROM w, unnest(range(1, len(ws) - 6)) AS u(i)
), rep AS (
  SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1
), cov AS (
  SELECT doc_id, sum(least(8, i - coalesce(prev, -100)))::BIGINT AS n FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM rep) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         (length(t) - length(replace(t, '!', '')))::BIGINT AS n_marks, len(ls)::BIGINT AS n_lines,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov USING (doc_id)
), f AS (
  SELECT *, ((n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT + 4 * (10 * n_symbols > word_chars)::BIGINT
    + 8 * (n_dup_lines > 3 AND 2 * n_dup_lines > n_lines)::BIGINT + 16 * (word_chars > 20 * n_words)::BIGINT
    + 32 * (n_marks > 20 AND 4 * n_marks > n_words)::BIGINT)::BIGINT AS failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) != 0 AS base_failed, (failed & 63) = 0 AS kept, n_marks, n_lines, failed FROM f
"""

COLLOCATIONS = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents
), ws AS (
  SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece
), one AS (
  SELECT lang, p, count(*) AS f FROM ws, unnest(w) AS u(p) GROUP BY ALL
), two AS (
  SELECT lang, w[i] AS w1, w[i + 1] AS w2, count(*) AS f FROM ws, unnest(range(1, len(w))) AS u(i) GROUP BY ALL
), three AS (
  SELECT lang, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3, count(*) AS f FROM ws, unnest(range(1, len(w) - 1)) AS u(i) GROUP BY ALL HAVING count(*) >= 10
), over_ AS (
  SELECT lang, w1, w2, max(f) AS f FROM (SELECT lang, w1, w2, f FROM three UNION ALL SELECT lang, w2, w3, f FROM three) GROUP BY ALL
), scored AS (
  SELECT t.lang, t.w1 || ' ' || t.w2 AS phrase, t.f AS a, x.f AS l, y.f AS r, 1000000::HUGEINT * t.f * t.f // (x.f::HUGEINT * y.f) AS score
  FROM two t JOIN one x ON x.lang = t.lang AND x.p = t.w1 JOIN one y ON y.lang = t.lang AND y.p = t.w2
  LEFT JOIN over_ o ON o.lang = t.lang AND o.w1 = t.w1 AND o.w2 = t.w2
  WHERE t.f >= 10 AND (o.f IS NULL OR 100 * o.f < 50 * t.f)
  UNION ALL
  SELECT lang, phrase, a, CASE WHEN s2 < s1 THEN l2 ELSE l1 END, CASE WHEN s2 < s1 THEN r2 ELSE r1 END, least(s1, s2) FROM (
    SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3 AS phrase, t.f AS a, x.f AS l1, yz.f AS r1, xy.f AS l2, z.f AS r2,
           1000000::HUGEINT * t.f * t.f // (x.f::HUGEINT * yz.f) AS s1, 1000000::HUGEINT * t.f * t.f // (xy.f::HUGEINT * z.f) AS s2
    FROM three t JOIN one x ON x.lang = t.lang AND x.p = t.w1 JOIN one z ON z.lang = t.lang AND z.p = t.w3
    JOIN two xy ON xy.lang = t.lang AND xy.w1 = t.w1 AND xy.w2 = t.w2 JOIN two yz ON yz.lang = t.lang AND yz.w1 = t.w2 AND yz.w2 = t.w3)
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM scored)
JOIN (SELECT lang, sum(f)::BIGINT AS n FROM one GROUP BY lang) USING (lang) WHERE rank <= 2000
"""

#: crc32 of a decimal number's digits, by reduction over their codes and, for each, over eight bits.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda h, x: list_reduce(list_prepend(xor(h, x), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)), 4294967295::BIGINT)"

PREFIX_TRIE = f"""
WITH given AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT c, list(struct_pack(d := sha256(strlen(role)::VARCHAR || ':' || role || text), b := strlen(text)::BIGINT) ORDER BY turn NULLS FIRST, sha256(strlen(role)::VARCHAR || ':' || role || text)) AS ts FROM given GROUP BY c
), hashed AS (
  SELECT c, ts, {_CRC} % 9 AS h FROM own
), laid AS (
  SELECT a.c, list_concat(coalesce(b.ts, [])[1:a.h], a.ts[a.h + 1:]) AS ts FROM hashed a LEFT JOIN own b ON b.c = a.c - a.c % 5
), member AS (
  SELECT c, d, CASE WHEN d = 0 THEN 0 ELSE ts[d].b END AS b, d = len(ts) AS ends, array_to_string(list_transform(ts[1:d], lambda t: t.d), ',') AS id,
         CASE WHEN d > 0 THEN array_to_string(list_transform(ts[1:d - 1], lambda t: t.d), ',') END AS parent FROM laid, unnest(range(0, len(ts) + 1)) AS u(d)
), node AS (
  SELECT id, any_value(parent) AS parent, d AS depth, min(c) AS conv_id, count(*) AS n_convs, max(b) AS b,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM member GROUP BY id, d
), kids AS (
  SELECT parent AS id, count(*) AS n_children FROM node WHERE parent IS NOT NULL GROUP BY parent
), below AS (
  SELECT any_value(CASE WHEN k = 0 THEN '' ELSE substr(n.id, 1, k * 65 - 1) END) AS id, any_value(n.id) AS under, any_value(n.b * (n.n_convs - 1)) AS saved, any_value(kids.id IS NULL) AS leaf
  FROM node n LEFT JOIN kids ON kids.id = n.id, unnest(range(0, n.depth + 1)) AS u(k) GROUP BY n.id, k
), sums AS (
  SELECT id, count(*) FILTER (leaf) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM below GROUP BY id
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM node n LEFT JOIN kids ON kids.id = n.id LEFT JOIN node p ON p.id = n.parent JOIN sums s ON s.id = n.id
"""

WARC = """
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM (
  SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND first IS DISTINCT FROM page_id THEN first END AS refers_to FROM (
    SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages))
"""


def quality_ablations() -> str:
    """Failures by rule of the whole policy, on the same measurements."""
    from sievewright.llm.quality_rules import RULES

    rules = ", ".join(f"({bit}, '{name}')" for bit, (name, _) in enumerate(RULES))
    judged = QUALITY_RULES[: QUALITY_RULES.rindex("SELECT doc_id, n_words")]
    return judged + f"SELECT bit, rule, count(*) FILTER (failed & (1 << bit) <> 0) AS n_failed, count(*) FILTER (failed = 1 << bit) AS n_only FROM f, (VALUES {rules}) r(bit, rule) GROUP BY bit, rule"


def license_scan() -> str:
    """The license scan over DuckDB, with the registry written out as VALUES."""
    from sievewright.llm.license_texts import DIGESTS, NOTICES, TEXTS
    from sievewright.llm.licenses import ALL_RIGHTS, COPYRIGHT_LINE, SPEAKS_OF_IT, SPELLINGS

    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def digest(text: str) -> str:
        form = f"lower({text})"
        for pattern in (COPYRIGHT_LINE, ALL_RIGHTS):
            form = f"regexp_replace({form}, {quoted(pattern)}, '\\1', 'g')"
        for old, new in SPELLINGS:
            form = f"replace({form}, {quoted(old)}, {quoted(new)})"
        return f"sha256(trim(regexp_replace({form}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')))"

    rows = lambda entries: ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in entries.items())
    return f"""
    WITH known AS (SELECT license_id, {digest("body")} AS digest FROM (VALUES {rows(TEXTS)}) t(license_id, body) UNION ALL SELECT * FROM (VALUES {rows(DIGESTS)}) u(license_id, digest)),
    notice AS (SELECT license_id, {digest("body")} AS d FROM (VALUES {rows(NOTICES)}) t(body, license_id)),
    line AS (SELECT row_id, l FROM (SELECT rowid_ AS row_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l FROM (SELECT *, row_number() OVER () AS rowid_ FROM documents))
             WHERE regexp_matches(lower(l), '{SPEAKS_OF_IT}')),
    hit AS (SELECT row_id, string_agg(DISTINCT n.license_id, ',' ORDER BY n.license_id) AS notices, count(*) AS n FROM line JOIN notice n ON {digest("l")} = n.d GROUP BY row_id),
    doc AS (SELECT doc_id, row_number() OVER () AS row_id, {digest("coalesce(text, '')")} AS digest FROM documents)
    SELECT doc_id, doc.digest, license_id, coalesce(hit.notices, '') AS notices, coalesce(n, 0)::BIGINT AS n_notice_lines
    FROM doc LEFT JOIN known ON doc.digest = known.digest LEFT JOIN hit USING (row_id)
    """
