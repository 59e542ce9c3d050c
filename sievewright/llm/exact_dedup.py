"""Exact de-duplication by content-defined chunk recipes, in DataFrame functions only.

A text is cut where its own content says so, every distinct chunk is shuffled once to give it a
verified identifier, and documents are then compared by their ordered identifier lists. Long texts
never move again after the chunk dictionary is made.

Defined results: a null text counts as empty; empty texts are equal to each other; ties of an id go
to all its rows: rows that share both text and id share one verdict, and `deduplicate` keeps one of
them; a null id never wins against a non-null one, and in a group of null ids keep_id is null and
`deduplicate` keeps one row. An empty table gives an empty result. Text of any length is read whole.
Other columns of the input play no part and may have any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.llm.common import narrow
from sievewright.session import Scratch, cut

#: A chunk ends before a word that starts with b, c or d, after a word that ends with d or t.
BOUNDARY = r"[dt][.,!?]?\s(?=[b-d])"
#: Where no such place comes up within a chunk's length: ends of sentences and lines of code, in any
#: script, and certain pairs of letters or digits, for numbers, encoded data and unspaced scripts.
ELSEWHERE = r"[.!?]\s|[。！？؟।;{}]|[07cgkoCGKO+](?=[^0-9A-Za-z]?[3imqIMQ/])|[นมร](?=[กทเ])"
MIN_CHARS, MAX_CHARS = 256, 4096
#: A group of more than one row in this many is dealt over slices on the way back to its rows.
SHARE = 1000


def chunk_pattern(boundary: str = BOUNDARY, elsewhere: str = ELSEWHERE, least: int = MIN_CHARS, most: int = MAX_CHARS) -> str:
    """Regex whose successive matches are the chunks; they cover the whole text."""
    body = rf".{{{least},{most}}}?"
    return rf"(?s){body}(?:{boundary}|\z)|{body}(?:{elsewhere})|.{{1,{most}}}"


def chunks(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def dictionary(docs: DataFrame, pattern: str, digest: Callable[[Column], Column]) -> DataFrame:
    """Every distinct chunk (compared byte by byte) with its digest: columns digest, chunk."""
    pieces = docs.select(F.explode(chunks(F.col("text"), pattern)).alias("chunk"))
    return pieces.distinct().select(digest(F.col("chunk")).alias("digest"), "chunk")


def ambiguous(entries: DataFrame) -> DataFrame:
    """Digests that more than one distinct chunk has; normally none."""
    return entries.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest")


def recipes(docs: DataFrame, pattern: str = "", digest: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """Adds ``recipe``, the ordered list of verified chunk identifiers, to (doc_id, text).

    The dictionary is checked before it is relied on: a digest that a single chunk has is that
    chunk's identifier. Should a digest be shared, the chunks that share it are numbered, and the
    documents that hold one of them get (digest, number) pairs written out in their lists.
    """
    pattern = pattern or chunk_pattern()
    plain = docs.withColumn("recipe", F.transform(chunks(F.col("text"), pattern), lambda c: F.array(digest(c), F.lit(0).cast("long"))))
    entries = dictionary(docs, pattern, digest)
    shared = cut(ambiguous(entries))
    if shared.isEmpty():
        return docs.withColumn("recipe", F.transform(chunks(F.col("text"), pattern), lambda c: digest(c)))
    from pyspark.sql import Window

    numbered = entries.join(shared, "digest", "left_semi").withColumn(
        "number", F.row_number().over(Window.partitionBy("digest").orderBy("chunk")).cast("long")
    )
    # Documents with the same text get the same list whichever of them is looked at, so the list is
    # made once for each distinct affected text.
    holds = plain.select("text", F.explode(F.transform("recipe", lambda r: r[0])).alias("digest")).join(shared, "digest", "left_semi").select("text").distinct()
    pieces = holds.select("text", F.posexplode(chunks(F.col("text"), pattern)).alias("pos", "chunk")).withColumn("digest", digest(F.col("chunk")))
    listed = (
        pieces.join(numbered, ["digest", "chunk"], "left")
        .groupBy("text")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "digest", F.coalesce("number", F.lit(0).cast("long")).alias("number")))), lambda p: F.array(p["digest"], p["number"])).alias("exact"))
    )
    return plain.join(listed, "text", "left").withColumn("recipe", F.flatten(F.coalesce("exact", "recipe"))).drop("exact")


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str = "", digest: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Lists are made once and written, so the texts are not read again. The rows of a group meet only
    as partial counts. The way back is a join on the list, in which the rows of a large group are
    dealt over as many slices as it has thousandths of the table, each with its copy of the verdict.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(recipes(narrow(docs, doc_id=id_col, text=text_col), pattern, digest).select("doc_id", "recipe", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")))
    groups = scratch.keep(rows.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    n = rows.count()
    # Fewer than SHARE groups can be that large, so they are few enough to go to every task. Lists of
    # one hash are sliced alike, so a shared hash does no harm.
    hot = F.broadcast(groups.filter(F.col("group_size") * SHARE > n).groupBy(F.xxhash64("recipe").alias("hash")).agg((F.floor(F.max("group_size") * SHARE / F.lit(n)) + 1).alias("slices")))
    sliced = lambda df: df.withColumn("hash", F.xxhash64("recipe")).join(hot, "hash", "left").withColumn("slices", F.coalesce("slices", F.lit(1).cast("long")))
    each = sliced(rows).withColumn("slice", F.pmod(F.monotonically_increasing_id(), F.col("slices"))).drop("hash", "slices")
    copies = sliced(groups).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))).drop("hash", "slices")
    return each.join(copies, ["recipe", "slice"]).select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows whose text no row with a larger id has; all columns stay as they are. One of
    several rows with the same text and id stays, and of equal texts that only rows with a null id
    have, one row."""
    judged = verdicts(docs, id_col, text_col)
    marked = docs.withColumn("__sha", F.sha2(F.coalesce(docs[text_col], F.lit("")), 256))
    own = [F.col(c) for c in docs.columns]
    winners = judged.filter("kept").groupBy(F.col("doc_id").alias("__kept_id"), F.col("text_sha256").alias("__kept_sha")).agg(F.count(F.lit(1)).alias("__n"))
    taken = lambda who: marked.join(who, (F.col(id_col) == F.col("__kept_id")) & (F.col("__sha") == F.col("__kept_sha")), "left_semi")
    repeated = winners.filter("__n > 1")
    if repeated.isEmpty():
        kept = taken(winners).select(*own)
    else:
        kept = taken(winners.filter("__n = 1")).unionByName(taken(repeated).dropDuplicates([id_col, "__sha"])).select(*own)
    nameless = marked.filter(F.col(id_col).isNull())
    if nameless.isEmpty():
        return kept
    alone = judged.filter("doc_id is null and keep_id is null").select(F.col("text_sha256").alias("__sha")).distinct()
    return kept.unionByName(nameless.join(alone, "__sha", "left_semi").dropDuplicates(["__sha"]).select(*own))
