"""Near-duplicate classes by ProbMinHash signatures, banding and exact verification.

1. Every text becomes weighted five-word shingles; texts with equal shingle counts form one class at
   once and go on as its least id.
2. ProbMinHash signatures of the classes are cut into bands; equal bands meet in buckets, and of
   buckets with the same members the one with the least key stays. Four bits of each register make a
   sketch that estimates the similarity of two members by a few XORs.
3. Links are found in rounds. In each bucket a few leaders, the same in buckets alike, meet the members
   that are not yet connected to them, each pair in the least of the buckets it shares; pairs whose
   estimate is within 4.5 standard deviations of the threshold are verified on their texts. A bucket of
   many members is cut into slices, and its leaders go to each slice, so no task meets a whole bucket; a
   task compares a slice with its leaders in batches. A leader that has met all others leaves the bucket.
   Texts meet their classes in one row each, before they are dealt to the buckets; a link joins the
   classes of its texts. Buckets whose members are all connected are done, the others get more leaders
   each round, so a large group of copies costs about its size, and every pair of different texts that
   meets in a bucket is either compared or already connected.
4. The verified links (probability Jaccard of at least the threshold) are contracted to components.

With 64 bands of 8 registers a pair at similarity 0.8 meets with probability 0.99999 (that it is
looked for in a wrong bucket, by halves of keys, has probability 2e-6). Nothing is
capped. Joins send narrow tables (ids of bucket members, bucket states, labels) around where these
have at most BROADCAST_ROWS rows, and merge larger ones; else only loop counters reach the driver.

Defined results: null or empty texts form one class; a row with a null id is never linked and has a
null class; repeated rows with one id share its class (an id is a key: where its rows differ, the
greatest text is verified); ties go to the least id; an empty table gives an empty result; texts of
any length are read whole. Ids are whole numbers. Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.llm import shingles as sh
from sievewright.llm.common import attach, narrow
from sievewright.llm.components import contract, labels
from sievewright.session import Scratch

BANDS, ROWS = 64, 8
SIMILARITY = 0.8
LEADERS, GROWTH = 4, 32  #: a bucket's leaders in the first round, and times as many in each next one
HELD = 500_000  #: shingles of texts that a task keeps while it verifies pairs; 16 bytes each
TOGETHER = 1 << 15  #: pairs whose sketches a task compares at once; 768 bytes each
SLICE = 4096  #: bucket members that meet the bucket's leaders in one place
BROADCAST_ROWS = 500_000  #: of narrow tables (ids, bucket states, labels) that joins send around; 8 to 24 bytes each


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, words: int = sh.WORDS) -> DataFrame:
    """doc_id, print (of the shingle counts), bands (one key each; none without words), bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, keys, bits = [], [], []
            for text in batch.column(1):
                hashes, counts = sh.shingles(text.as_py(), words)
                prints.append(hashlib.blake2b(hashes.tobytes() + counts.tobytes(), digest_size=16).digest())
                signature = sh.prob_minhash(hashes, sh.weights(counts), bands * rows) if len(hashes) else None
                keys.append(np.empty(0, np.int64) if signature is None else sh.band_keys(signature, bands))
                bits.append([] if signature is None else sh.sketch(signature))
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            values = pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), values), pa.array(bits, pa.list_(pa.int64()))], names=["doc_id", "print", "bands", "bits"])
        pa.default_memory_pool().release_unused()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, print binary, bands array<long>, bits array<long>")


def verified(pairs: DataFrame, texts: DataFrame, similarity: float, words: int = sh.WORDS) -> DataFrame:
    """(a, b, similar) for pairs (u, v, a, b): u and v are compared by their exact probability Jaccard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        held = 0

        def of(name: int, text: str) -> tuple[np.ndarray, np.ndarray]:
            nonlocal held
            if name not in kept:
                if held > HELD:
                    kept.clear()
                    held = 0
                kept[name] = sh.shingles(text, words)
                held += len(kept[name][0])
            return kept[name]

        for batch in batches:
            u, v = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            close = [sh.probability_jaccard(of(i, x.as_py()), of(j, y.as_py())) >= similarity for i, j, x, y in zip(u, v, batch.column(4), batch.column(5))]
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), pa.array(close, pa.bool_())], names=["a", "b", "similar"])

    right = pairs.join(texts.select(F.col("doc_id").alias("v"), F.col("text").alias("text_v")), "v")
    both = right.join(texts.select(F.col("doc_id").alias("u"), F.col("text").alias("text_u")), "u")
    return both.select("u", "v", "a", "b", "text_u", "text_v").mapInArrow(run, "a long, b long, similar boolean")


def sized(small: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A written table with the hint for its size: sent around up to a bound, else merged."""
    return small.hint("broadcast" if small.count() <= most else "merge")


def buckets(spread: DataFrame, scratch: Scratch) -> DataFrame:
    """(bucket, x) of the buckets with two members or more, one bucket for each set of members."""
    shared = spread.groupBy("bucket").count().filter("count > 1").select("bucket")
    # A merge join at every size; a hot bucket's side of it is split by Spark's skew handling.
    met = scratch.keep(spread.join(shared.hint("merge"), "bucket", "left_semi"))
    facts = met.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("least"), F.sum(F.xxhash64("x").cast("decimal(38,0)")).alias("total"))
    # The least bucket is the one in which a pair is looked at.
    chosen = facts.groupBy("n", "least", "total").agg(F.min("bucket").alias("bucket")).select("bucket")
    out = scratch.keep(met.join(chosen, "bucket", "left_semi"))
    scratch.drop(met)
    return out


def far_apart(similarity: float, registers: int) -> int:
    """Differing sketch bits beyond which similarity is below the threshold by 4.5 deviations: of the
    four bits of a register that differs, each differs by a coin's throw."""
    p = 1 - similarity
    return int(np.ceil(2 * registers * p + 4.5 * np.sqrt(registers * (5 * p - 4 * p * p))))


def code(bucket: Column) -> Column:
    """The upper half of a bucket's key."""
    return F.shiftright(bucket, 32).cast("int")


def meetings(dealt: DataFrame, far: int) -> DataFrame:
    """(u, v, a, b): texts u < v of the classes a and b whose sketches differ in at most ``far`` bits. Rows of
    ``dealt`` are (bucket, slice, own, leads, x, c, bits, codes); the leaders of a bucket stand in each of its
    slices and meet the slice's own rows. A task reads slices in order, own rows first, and holds those only."""

    def columns(batch: pa.RecordBatch) -> list[np.ndarray]:
        flat = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
        bits, codes = (batch.column(k).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1) for k in (6, 7))
        return [*flat, bits.view(np.uint64), codes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # own rows of the last slice, which the next batch may go on with
        for batch in batches:
            if not len(batch):
                continue
            rows = columns(batch)
            old = 0
            if held is not None and (held[0][0], held[1][0]) == (rows[0][0], rows[1][0]):
                old = len(held[0])
                rows = [np.concatenate(both) for both in zip(held, rows)]
            bucket, slice_, own, leads, x, c, bits, codes = rows
            first = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (slice_[1:] != slice_[:-1])])
            group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(x)]))
            owned = first + np.add.reduceat(own.astype(np.int64), first)
            # Rows held have met each other.
            heads = np.flatnonzero(leads)
            low = np.where(heads < old, old, first[group[heads]])
            met = np.maximum(owned[group[heads]] - low, 0)
            ends = np.cumsum(met)
            at = 0
            while at < len(heads):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOGETHER, "right")))
                many = met[at:to]
                i = np.repeat(heads[at:to], many)
                j = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low[at:to], many)
                # Once where both lead.
                once = (c[i] != c[j]) & (~leads[j] | (x[j] < x[i]))
                i, j = i[once], j[once]
                close = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64) <= far
                i, j = i[close], j[close]
                # A pair is looked at in the least bucket it shares.
                least = np.where(codes[i] == codes[j], codes[i], np.iinfo(np.int32).max).min(axis=1)
                here = least == bucket[i] >> 32
                i, j = i[here], j[here]
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x[i], x[j])), pa.array(np.maximum(x[i], x[j])), pa.array(c[j]), pa.array(c[i])], names=["u", "v", "a", "b"])
                at = to
            held = [r[first[-1] : owned[-1]].copy() for r in rows]
            if not len(held[0]):
                held = None

    order = dealt.select("bucket", "slice", "own", "leads", "x", "c", "bits", "codes")
    placed = order.repartition("bucket", "slice").sortWithinPartitions("bucket", "slice", F.col("own").desc())
    return placed.mapInArrow(run, "u long, v long, a long, b long")


def links(members: DataFrame, sketches: DataFrame, texts: DataFrame, similarity: float, registers: int, scratch: Scratch) -> DataFrame | None:
    """Edges that connect whatever pairs of bucket members connect; None if there are none. ``members``
    has a row for each text (x, buckets), ``sketches`` (x, bits, codes). Each round's verified links join
    those of the rounds before, which stay contracted to stars."""
    stars, label, kept = None, None, members
    leaders = LEADERS
    while not members.isEmpty():
        # A text leads in all its buckets or few: copies that share many buckets meet the same leaders in each.
        members = members.withColumn("h", F.xxhash64("x", F.lit(leaders)))
        # Texts meet their classes and sketches in one row each, and are dealt to their buckets after it.
        if label is None:
            named = members.withColumn("c", F.col("x"))
        else:
            named = members.join(sized(label), "x", "left").select("x", "buckets", "h", F.coalesce("label", "x").alias("c"))
        state = named.select(F.explode("buckets").alias("bucket"), "c", "h").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("low"), F.max("c").alias("high"), F.min("h").alias("lead")).filter("low < high").select("bucket", "lead", "n")
        state = scratch.keep(state)
        if state.isEmpty():
            break
        share = F.pmod("h", F.lit(1 << 30)) / float(1 << 30)
        slices = F.ceil(F.col("n") / SLICE)
        leads = (F.col("h") == F.col("lead")) | (share * F.col("n") < leaders - 1)
        small = sized(state)
        wide = named.join(sketches, "x").select(F.explode("buckets").alias("bucket"), "x", "c", "h", "bits", "codes").join(small, "bucket")
        mine = F.pmod(F.xxhash64("x"), slices)
        places = F.when(leads, F.sequence(F.lit(0).cast("long"), slices - 1)).otherwise(F.array(mine))
        dealt = wide.select("bucket", F.explode(places).alias("slice"), mine.alias("mine"), leads.alias("leads"), "x", "c", "bits", "codes").withColumn("own", F.col("slice") == F.col("mine"))
        pairs = scratch.keep(meetings(dealt, far_apart(similarity, registers)))
        asked = scratch.keep(pairs.select(F.col("u").alias("doc_id")).union(pairs.select("v")).distinct())
        tested = scratch.keep(verified(pairs, texts.join(sized(asked), "doc_id", "left_semi"), similarity))
        # Texts are linked to their classes already, so a link joins these: many links, few edges.
        new = scratch.keep(tested.filter("similar").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())
        if not new.isEmpty():
            stars = contract(new if stars is None else stars.union(new), most_rounds=2)
            scratch.drop(label)
            label = scratch.keep(labels(stars).select(F.col("node").alias("x"), "label"))
        # Leaders have met the others of their buckets.
        left = members.select(F.explode("buckets").alias("bucket"), "x", "h").join(small, "bucket").filter(~leads)
        last, members = kept, scratch.keep(left.groupBy("x").agg(F.collect_list("bucket").alias("buckets")))
        kept = members
        for done in (state, pairs, asked, tested, last):
            scratch.drop(done)
        leaders *= GROWTH
    return stars


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, bands: int = BANDS, rows: int = ROWS, similarity: float = SIMILARITY) -> DataFrame:
    """One row per input row: doc_id, class_id (the least id of its class), class_size, kept."""
    scratch = Scratch(docs.sparkSession)
    given = narrow(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    signed = scratch.keep(signatures(given.filter("doc_id is not null"), bands, rows))
    # Copies meet as partial minima; what goes on is one row for each text and, after it, each id.
    firsts = signed.groupBy("print").agg(F.min_by(F.struct("doc_id", "bands", "bits"), "doc_id").alias("s"), F.count(F.lit(1)).alias("copies")).select("print", F.col("s.doc_id").alias("x"), "s.bands", "s.bits", "copies")
    shown = scratch.keep(firsts)
    spread = shown.select("x", F.explode(F.array_distinct("bands")).alias("bucket"))
    met = buckets(spread, scratch)
    listed = scratch.keep(met.groupBy("x").agg(F.collect_list("bucket").alias("buckets")))  # a bucket a band at most
    scratch.drop(met)
    wanted = sized(listed.select("x"))
    texts = scratch.keep(given.join(wanted, F.col("doc_id") == F.col("x"), "left_semi").groupBy("doc_id").agg(F.max("text").alias("text")))
    sketches = scratch.keep(shown.join(wanted, "x", "left_semi").groupBy("x").agg(F.min(F.struct("bits", "bands")).alias("s")).select("x", "s.bits", F.transform("s.bands", code).alias("codes")))
    found = links(listed, sketches, texts, similarity, bands * rows, scratch)
    known = shown.select("print", F.col("x").alias("class_id"), "copies")
    if found is not None:
        label = labels(contract(found)).select(F.col("node").alias("class_id"), "label")
        known = known.join(label, "class_id", "left").select("print", F.coalesce("label", "class_id").alias("class_id"), "copies")
    # One text, and one class, may have a third of all rows: these are met in slices.
    named = scratch.keep(attach(signed.select("doc_id", "print"), "print", known, "copies", F.unhex(F.hex(F.xxhash64("doc_id")))).select("doc_id", "class_id"))
    scratch.drop_all_but(named)
    sizes = named.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size"))
    out = attach(named, "class_id", sizes.withColumn("asking", F.col("class_size")), "asking", F.xxhash64("doc_id")).select("doc_id", "class_id", "class_size", (F.col("doc_id") == F.col("class_id")).alias("kept"))
    alone = given.filter("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"))
    return out.union(alone)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The input's rows, one document of each class; rows with a null id stay."""
    dropped = classes(docs, id_col, text_col, **options).filter("not kept").select(F.col("doc_id").alias("__dropped"))
    return docs.join(dropped, docs[id_col].cast("long") == F.col("__dropped"), "left_anti")
