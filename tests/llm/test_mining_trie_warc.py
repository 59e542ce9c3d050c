"""Phrases, the conversation trie and the archive against brute force, on odd and hot tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from decimal import Decimal

import pytest
import zstandard

from sievewright.llm import collocations, prefix_trie, warc
from sievewright.session import Scratch

DOCS = "doc_id long, text string, lang string, w1 string, n long, slice int, bucket int"


def documents(spark, rows):
    return spark.createDataFrame([(k, t, la, "x", 1, 2, 3) for k, (t, la) in enumerate(rows)], DOCS).repartition(3)


def phrases(rows, longest=3, least=10, best=2000, share=50):
    """The definition, by counting every phrase of every length."""
    seen, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").encode().lower().decode()):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            total[lang] += len(words)
            for m in range(1, longest + 1):
                seen[lang].update(zip(*[words[i:] for i in range(m)]))
    out = []
    for lang, f in seen.items():
        many = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {q for p, a in many.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= share * f[q := p[i : i + m]]}
        found = []
        for p, a in many.items():
            if p not in inside:
                worth, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-worth, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, rank, p.decode(), -a, le, r, total[lang], -w) for rank, (w, a, p, le, r) in enumerate(sorted(found)[:best], 1)]
    return sorted(out)


def mined(docs, longest=3, least=10, best=2000):
    rows = collocations.mine(collocations.frequencies(docs, longest, least), longest, best=best)
    return sorted(tuple(r) for r in rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def chatter(rng, words, n):
    return "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", " ", ". ", ",", "\n", "\x0b", "　"]) for _ in range(n))


def test_phrases_are_those_of_the_definition(spark, monkeypatch):
    rng = random.Random(5)
    words = ["The", "a", "of", "Éa", "éa", "straße", "x1", "#", "​", "İ", "ab\x85cd", "I'm"]
    rows = [(chatter(rng, words, rng.randint(0, 90)), rng.choice(["en", "de", None, "und", "a\tb\nc"])) for _ in range(150)]
    rows += [(None, "en"), ("", None), (" \t ", "en"), ("...,,", "en"), ("lone", "zz")] + [("one two three four", "xx")] * 12
    docs = documents(spark, rows)
    assert mined(docs) == phrases(rows)
    monkeypatch.setattr(collocations, "CHUNK", 64)
    assert [list(collocations._parts(t)) for t in (b"a" * 200, b"ab. " * 30)][0] == [b"a" * 200]
    assert mined(documents(spark, rows), 4, 6, 25) == phrases(rows, 4, 6, 25)
    assert mined(documents(spark, rows), 2, 3) == phrases(rows, 2, 3)


def test_long_texts_are_cut_where_pieces_end(monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK", 100)
    rng = random.Random(1)
    for _ in range(50):
        text = chatter(rng, ["aa", "b", "cccc"], rng.randint(0, 300)).encode()
        parts = list(collocations._parts(text))
        assert len(b"".join(parts)) + len(parts) - 1 == len(text)
        pieces = lambda t: [p.split() for p in re.split(rb"[.,;:!?\x0A-\x0D]", t) if p.split()]
        assert [p for part in parts for p in pieces(part)] == pieces(text)


def test_one_phrase_in_a_third_of_all_windows(spark):
    rows = [("hot pair " * 300 + " ".join(f"hot pair w{k}x{j}" for j in range(100)), "en") for k in range(12)] + [(f"cold word{k} tail", "en") for k in range(300)]
    assert mined(documents(spark, rows)) == phrases(rows)


def test_scores_beyond_64_bits_are_exact(spark):
    cases = [(10**13 - 7, 10**13 + 3, 99_999_999_999_999), (3, 7, 11), (10, 10, 10), (2**40, 2**41 + 1, 2**42 - 1)]
    from pyspark.sql import functions as F

    got = spark.createDataFrame(cases, "a long, l long, r long").select("a", "l", "r", collocations.score(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()
    for a, left, right, s in got:
        assert s == 1_000_000 * a * a // (left * right)
    assert Decimal(1)


def test_no_documents_no_phrases(spark):
    assert mined(spark.createDataFrame([], DOCS)) == []
    assert mined(documents(spark, [(None, None), ("", "en")])) == []


TURNS = "conv_id long, turn long, role string, text string, p int, c int, id int, parent int, n int"


def conversations(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], TURNS).repartition(parts)


def laid_out(rows):
    """conv_id to its rebuilt turns."""
    given = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            given[c].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in given.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - c % 5 if c >= 0 else -(-c - (-c) % 5)
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute_trie(rows):
    laid = laid_out(rows)
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in laid.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) if kids[node] else 1
        saved[node] = sum(saved[k] for k in kids[node]) + ((len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0)
    return sorted(
        (min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids[n]), leaves[n], saved[n], hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest())
        for n, m in members.items()
    )


def built(spark, turns):
    scratch = Scratch(spark)
    rows = prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.ordered(turns, scratch)), scratch)
    return [tuple(r) for r in rows.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()]


def order(rows):
    return sorted(rows, key=repr)


def test_trie_of_odd_conversations(spark):
    rng = random.Random(9)
    rows = []
    for c in [*range(40), 7, 7, -3, -5, 10**12, 10**12 + 1]:
        for turn in range(rng.randint(1, 14)):
            rows.append((c, rng.choice([turn, turn, turn, None, 3]), rng.choice(["user", "assistant", None, ""]), rng.choice(["a", "b", "é" * 5, None, "", "x" * 5000])))
    rows += [(None, 1, "user", "lost"), (50, 1, "1:a", "b"), (51, 1, "1", ":ab")] + [(60, 1, "user", "same")] * 4
    assert order(built(spark, conversations(spark, rows))) == order(brute_trie(rows))


@pytest.mark.parametrize("block", [4, 1024])
def test_trie_with_one_long_and_many_equal_conversations(spark, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "MEMBERS", 7)
    rows = [(3, t, "user", f"turn {t % 3}") for t in range(150)] + [(4, t, "user", f"turn {t % 3}") for t in range(90)]
    rows += [(c, t, "user", "hello") for c in range(100, 220) for t in range(2)] + [(c, 0, "user", f"only {c}") for c in range(300, 420)]
    assert order(built(spark, conversations(spark, rows, 5))) == order(brute_trie(rows))


def test_trie_of_no_conversations(spark):
    assert built(spark, conversations(spark, [])) == []


def test_sums_by_contraction_on_random_trees(spark):
    rng = random.Random(2)
    depth, parent, weight = {0: 0}, {0: prefix_trie.NO_PARENT}, {0: 5}
    for k in range(1, 150):
        up = k - 1 if rng.random() < 0.8 else rng.randrange(k)
        parent[k], depth[k], weight[k] = str(up), depth[up] + 1, rng.randint(0, 9)
    kids = Counter(parent.values())
    tree = spark.createDataFrame([(str(k), parent[k], depth[k], kids[str(k)], weight[k], 1) for k in parent], "id string, parent string, depth long, n_children long, w long, one long")
    got = {r["id"]: (r["w"], r["one"]) for r in prefix_trie.subtree_sums(tree, ["w", "one"], Scratch(spark)).collect()}
    want = {k: [weight[k], 1] for k in parent}
    for k in sorted(parent, reverse=True):
        if k:
            for i in (0, 1):
                want[int(parent[k])][i] += want[k][i]
    assert got == {str(k): tuple(v) for k, v in want.items()}


PAGES = "page_id long, url string, html string, digest string, bytes int, key string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "d", 1, "k") for r in rows], PAGES).repartition(3)


ODD = [(1, "http://a/ b", "x" * 99), (2, None, "x" * 99), (3, "u\r\nWARC-Type: fake", "é" * 50), (9, "u", "é" * 50), (4, "u", None), (5, "u", ""), (6, "u", "long " * 60_000), (7, "u", "long " * 60_000), (7, "u", "long " * 60_000), (None, "u", "é" * 50), (None, None, "solo" * 40), (8, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" * 5), (10, "", "\r\n\r\n" * 40)]


def verdicts(rows):
    first = {}
    for page, _, html in rows:
        if html and len(html.encode()) >= 100 and page is not None:
            first[html] = min(page, first.get(html, page))
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        to = first.get(html) if len(body) >= 100 and first.get(html) != page else None
        out.append((page, len(body), hashlib.sha256(body).hexdigest(), "revisit" if to is not None else "response", to))
    return out


def test_archive_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FRAME", 2000)
    table, path = pages(spark, ODD), str(tmp_path / "archive")
    warc.write(table, path)
    records = warc.read(spark, path)
    got = [tuple(r) for r in warc.digest_rows(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert order(got) == order(verdicts(ODD))
    for r in records.filter("record_type = 'response'").collect():
        assert hashlib.sha256(r["payload"]).hexdigest() == r["payload_digest"]
    index = spark.read.parquet(f"{path}/index").collect()
    for name in {r["bundle"] for r in index}:
        packed = (tmp_path / "archive" / "bundles" / name).read_bytes()
        whole = zstandard.ZstdDecompressor().stream_reader(packed, read_across_frames=True).read()
        n, at = 0, 0
        while at < len(whole):
            one, at = warc.parse(whole, at)
            n += 1
        assert n == sum(r["bundle"] == name for r in index)
    asked = spark.createDataFrame([(6,), (9,), (None,), (77,)], "page_id long")
    found = [(r["page_id"], r["record_type"]) for r in warc.look_up(spark, path, asked).collect()]
    assert order(found) == order([("6", "response"), ("9", "revisit"), (None, "revisit"), (None, "response")])


def test_lost_attempts_are_not_read_and_damage_is_seen(spark, tmp_path):
    path = str(tmp_path / "archive")
    warc.write(pages(spark, ODD), path)
    stray = warc.Bundle(f"{path}/bundles")
    stray.add("urn:page:99", warc.record("99", None, hashlib.sha256(b"").hexdigest(), 0, None, b"", "1970-01-01T00:00:00Z"))
    stray.close()
    assert warc.read(spark, path).count() == len(ODD)
    data = warc.record("1", None, hashlib.sha256(b"good").hexdigest(), 4, None, b"good", "1970-01-01T00:00:00Z")
    assert warc.parse(data, 0)[0]["payload"] == b"good"
    with pytest.raises(ValueError, match="damaged"):
        warc.parse(data.replace(b"good", b"baad"), 0)


def test_widely_shared_payloads(spark, tmp_path, monkeypatch):
    from sievewright.llm import common

    monkeypatch.setattr(common, "WIDE", 5)
    rows = [(k, "u", "copy " * 50) for k in range(40)] + [(100 + k, "u", f"page {k // 2} " * 30) for k in range(30)]
    path = str(tmp_path / "archive")
    warc.write(pages(spark, rows), path)
    got = [tuple(r) for r in warc.digest_rows(warc.read(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert order(got) == order(verdicts(rows))


def test_archive_of_no_pages(spark, tmp_path):
    path = str(tmp_path / "archive")
    warc.write(spark.createDataFrame([], PAGES), path)
    assert warc.read(spark, path).collect() == []
