"""The corpus pipeline against brute force on a small table, stage by stage, and on odd tables."""

import itertools
import random

import pytest

import corpus_pipeline
from sievewright.llm import shingles as sh

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = [a + b + c for a, b, c in itertools.product("bcdfgl", "aeiou", "nrst")]


def write(spark, folder, rows, extra=""):
    spark.createDataFrame(rows, SCHEMA + extra).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def corpus(rng):
    rows = []
    for k in range(60):
        words = [rng.choice(VOCABULARY) for _ in range(rng.randint(5, 120))]
        rows.append((k, " ".join(words), "en", rng.choice(["a", "b", None])))
        if k % 4 == 0:
            rows.append((1000 + k, " ".join(words), "en", "b"))
        if k % 5 == 0 and len(words) > 60:
            words[3] = "other"
            rows.append((2000 + k, " ".join(words), "en", "a"))
    rows += [(3000, None, None, None), (3001, "", "en", "a"), (3002, "word " * 400, "en", "a")]
    return [(*r, len(r[1] or "")) for r in rows]


def test_each_stage_by_brute_force(spark, tmp_path):
    rows = corpus(random.Random(21))
    folder = write(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "exact_dedup", "near_dedup", "source_mixing", "packing"]
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality_rules"](spark, docs, folder)
    assert kept.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert set(texts) == {r[0] for r in rows if r[1] and len(r[1].split()) >= 20 and r[0] != 3002}
    single = stages["exact_dedup"](spark, kept, folder)
    alone = {r["doc_id"]: r["text"] for r in single.collect()}
    assert set(alone) == {k for k, t in texts.items() if k == max(j for j, u in texts.items() if u == t)}
    unlike = stages["near_dedup"](spark, single, folder)
    marks, dropped = {k: sh.shingles(t) for k, t in alone.items()}, set()
    for a, b in itertools.combinations(sorted(alone), 2):
        if sh.probability_jaccard(marks[a], marks[b]) >= 0.8:
            dropped.add(b)
    assert dropped and {r["doc_id"] for r in unlike.collect()} == set(alone) - dropped
    mixed = stages["source_mixing"](spark, unlike, folder)
    assert mixed.columns == docs.columns
    whole = {k: t for k, t in alone.items() if k not in dropped}
    for r in mixed.collect():
        assert whole[r["doc_id"]].startswith(r["text"].rstrip())
    packed = stages["packing"](spark, mixed, folder).collect()
    from tokenizers import Tokenizer

    from sievewright.llm import packing

    tokens = Tokenizer.from_file(packing.tokenizer_path())
    want = sum(len(tokens.encode(r["text"], add_special_tokens=False).ids) + 1 for r in mixed.collect())
    assert sum(r["length"] for r in packed) == want


def test_the_whole_run_is_repeatable(spark, tmp_path):
    folder = write(spark, tmp_path, corpus(random.Random(22)))
    runs = []
    for _ in range(2):
        taken = {}
        for r in corpus_pipeline.run(spark, folder).collect():
            taken.setdefault(r["doc_id"], []).append((r["length"], r["doc_tokens"]))
        runs.append({k: (sum(n for n, _ in v), sorted(t for _, t in v)[-1]) for k, v in taken.items()})
    assert runs[0] == runs[1] and len(runs[0]) > 20


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, 0, 1, 2)], [(None, "word " * 30, None, None, 0, 1, 2)] * 2])
def test_odd_tables_without_a_good_document_give_nothing(spark, tmp_path, rows):
    folder = write(spark, tmp_path, rows, ", bucket int, __row_id int")
    found = corpus_pipeline.run(spark, folder)
    assert found.collect() == [] and {"doc_id", "start", "length", "sequence_id"} <= set(found.columns)


def test_long_texts_missing_sources_and_ids_in_a_whole_run(spark, tmp_path):
    from tokenizers import Tokenizer

    from sievewright.llm import packing

    rng = random.Random(23)
    prose = lambda n: " ".join(rng.choice(VOCABULARY) + rng.choice(VOCABULARY) for _ in range(n))
    long, short = prose(20_000), prose(400)
    rows = [(5, long, None, None), (None, short, None, None), (None, short, "en", None), (7, prose(600), "en", "a"), (8, None, None, None)]
    folder = write(spark, tmp_path, [(*r, 0, 1, 2) for r in rows], ", bucket int, __row_id int")
    tokens, taken = Tokenizer.from_file(packing.tokenizer_path()), {}
    for r in corpus_pipeline.run(spark, folder).collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["length"]
    ids = len(tokens.encode(long, add_special_tokens=False).ids)
    assert set(taken) <= {5, 7, None} and {5, 7} <= set(taken)
    assert 0.05 * ids < taken[5] <= 3 * (ids + 1) and max(taken.values()) == taken[5]
