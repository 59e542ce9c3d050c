"""Phrase collocation mining by top-order marginalisation.

Every word of a piece starts one window: the word and its leads, padded with the empty string where
the piece ends. Only these longest windows are counted. A ROLLUP over their columns then sums the
shorter prefixes, and since each occurrence of a phrase starts exactly one window, the sum over a
prefix is the frequency of that phrase: no n-gram of another order is ever exploded.

Tasks count windows in chunks of bounded size (Arrow columns, one dictionary of words a chunk), so
that what is shuffled is counts, however common a phrase is: a prefix brings each distinct last word
once a chunk. The counts of a chunk go to buckets by language, first word and a slice of the second
(a very common first word meets in many buckets), in one row of sorted text a bucket. Where the rows
of a bucket meet, its windows are whole, and so are the sums over two words and more. Windows below
the threshold, which can't be candidates, are folded there into their prefix, longest first; ROLLUP
sums what is left over all buckets.

Odd input: a null text has no words; a null language is ``und``, together with a language of that
name; repeated rows count again; an empty table gives no rows; texts of any length are read whole, in
chunks that end where a piece ends (one piece is held whole); other columns are ignored. Equal scores
are ordered by frequency, then by the phrase's bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes that end a piece; those that end a word besides; A to Z in lower case.
PIECE = b".,;:!?\n\x0b\x0c\r"
BLANK = b" \t"
LOWER = bytes(range(65, 91)), bytes(range(97, 123))

#: Bytes of text that one round of counting holds; bounds the memory of a task.
CHUNK = 8 << 20
#: Buckets for each shuffle partition, so that buckets spread evenly over partitions; buckets of one first word.
BUCKETS, SPREAD = 8, 32
#: Slices over which phrases that ask for one common word are dealt; parts of a language that are ranked apart first.
SLICES, PARTS = 8, 32


def _kinds() -> np.ndarray:
    """By byte: 0 in a word, 1 between words, 2 between pieces."""
    kinds = np.zeros(256, np.uint8)
    kinds[list(BLANK)] = 1
    kinds[list(PIECE)] = 2
    return kinds


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, in lower case, with the end of a piece after each; and where each text ends."""
    table = bytes.maketrans(*LOWER)
    data = np.frombuffer(b"\n".join([*texts, b""]).translate(table), np.uint8)
    return data, np.cumsum([len(t) + 1 for t in texts])


def _words(data: np.ndarray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """The words, the byte at which each starts, and the piece that it belongs to."""
    kind = _kinds()[data]
    inside = kind == 0
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[inside]))
    return words, starts, np.searchsorted(np.flatnonzero(kind == 2), starts)


def _groups(columns: list[np.ndarray], sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The rows in the order of their tuples, and the place there at which each distinct tuple begins.
    Columns are packed into as few 64-bit keys as they fit."""
    keys, room = [columns[0].astype(np.int64)], 2**62 // sizes[0]
    for column, size in zip(columns[1:], sizes[1:], strict=True):
        if size > room:
            keys.append(column.astype(np.int64))
            room = 2**62 // size
        else:
            keys[-1] = keys[-1] * size + column
            room //= size
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    return order, _begins([key[order] for key in keys])


def _begins(columns: list[np.ndarray]) -> np.ndarray:
    """Places at which a value of sorted columns differs from the one before."""
    fresh = np.zeros(len(columns[0]), bool)
    fresh[:1] = True
    for column in columns:
        fresh[1:] |= np.diff(column) != 0
    return np.flatnonzero(fresh)


def _hashes(names: pa.StringArray) -> np.ndarray:
    """A 64-bit hash of each string, the same in every task."""
    offsets = np.frombuffer(names.buffers()[1], np.int32)[: len(names) + 1]
    data = np.frombuffer(names.buffers()[2] or b"", np.uint8)[: offsets[-1]].astype(np.uint64) + np.uint64(1)
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    data *= (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0xD6E8FEB86659FD93)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data, dtype=np.uint64)])
    mixed = (sums[offsets[1:]] - sums[offsets[:-1]]) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(31))


def count_windows(langs: list[str], texts: list[bytes], longest: int, buckets: int) -> pa.RecordBatch:
    """Distinct padded windows of a chunk of texts with their counts, one row for a language and bucket: the
    windows in byte order, a line each, their words joined by tabs; and the count of each. Words hold
    neither tabs nor line feeds."""
    data, ends = _joined(texts)
    words, starts, piece = _words(data)
    coded = words.dictionary_encode()
    names = pa.concat_arrays([pa.array([""], pa.string()), coded.dictionary])
    order = pc.sort_indices(names)
    rank = np.empty(len(order), np.int64)
    rank[np.asarray(order)] = np.arange(len(order))
    names = names.take(order)
    code = rank[np.asarray(coded.indices) + 1]
    spoken = pa.array(langs, pa.string()).dictionary_encode()
    lang = np.asarray(spoken.indices)[np.searchsorted(ends, starts, side="right")]
    leads = [code]
    for k in range(1, longest):
        lead = np.zeros_like(code)  # the empty string sorts first
        same = piece[k:] == piece[: max(0, len(code) - k)]
        lead[: len(same)][same] = code[k:][same]
        leads.append(lead)
    rows, first = _groups([lang, *leads], [len(spoken.dictionary), *[len(names)] * longest])
    n = np.diff(np.append(first, len(rows)))
    rows = rows[first]
    hashes = _hashes(names)
    mixed = hashes[leads[0][rows]] ^ _hashes(spoken.dictionary)[lang[rows]] * np.uint64(0x94D049BB133111EB)
    bucket = ((mixed + hashes[leads[1][rows]] % np.uint64(SPREAD)) % np.uint64(buckets)).astype(np.int32)
    place = np.lexsort([bucket, lang[rows]])
    rows, n, bucket = rows[place], n[place], bucket[place]
    first = _begins([bucket, lang[rows]])
    bounds = pa.array(np.append(first, len(rows)).astype(np.int32))
    lines = pc.binary_join_element_wise(*[names.take(pa.array(lead[rows])) for lead in leads], "\t")
    block = pc.binary_join(pa.ListArray.from_arrays(bounds, lines), "\n")
    return pa.RecordBatch.from_arrays([spoken.dictionary.take(pa.array(lang[rows][first])), pa.array(bucket[first]), block, pa.ListArray.from_arrays(bounds, pa.array(n.astype(np.int32)))], ["lang", "bucket", "block", "ns"])


def _parts(text: bytes) -> Iterator[bytes]:
    """A text in parts of about CHUNK bytes, cut where a piece ends."""
    begin = 0
    while len(text) - begin > CHUNK:
        cut = max(text.rfind(bytes([b]), begin, begin + CHUNK) for b in PIECE)
        if cut < 0:
            later = [p for b in PIECE if (p := text.find(bytes([b]), begin + CHUNK)) >= 0]
            if not later:
                break
            cut = min(later)
        yield text[begin:cut]
        begin = cut + 1
    yield text[begin:]


def _counter(longest: int, buckets: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, texts, held = [], [], 0
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"], strict=True):
                for part in _parts(text.as_buffer().to_pybytes()):
                    langs.append(lang)
                    texts.append(part)
                    held += len(part) + 1
                    if held >= CHUNK:
                        yield count_windows(langs, texts, longest, buckets)
                        langs, texts, held = [], [], 0
        if texts:
            yield count_windows(langs, texts, longest, buckets)

    return count


def _merger(longest: int, least: int):
    def merge(table: pa.Table) -> pa.Table:
        """The windows of one bucket: counts of equal ones added up, rare ones folded into their prefix."""
        rows = table.combine_chunks().to_batches()[0]
        ns = rows["ns"]
        spoken = rows["lang"].dictionary_encode()
        lang = np.repeat(np.asarray(spoken.indices), np.asarray(ns.value_lengths()))
        lines = pc.split_pattern(rows["block"], "\n").flatten()
        flat = pc.split_pattern(lines, "\t").flatten().dictionary_encode()
        words, code = flat.dictionary, np.asarray(flat.indices).reshape(-1, longest)
        blank = words.index("").as_py()
        if blank < 0:
            blank, words = len(words), pa.concat_arrays([words, pa.array([""], words.type)])
        columns = [lang, *code.T]
        sizes = [len(spoken.dictionary), *[len(words)] * longest]
        n = np.asarray(ns.flatten()).astype(np.int64)
        for depth in range(longest, 1, -1):
            place, first = _groups(columns, sizes)
            columns, n = [c[place[first]] for c in columns], np.add.reduceat(n[place], first)
            whole = n
            if depth < longest:
                place, first = _groups(columns[: depth + 1], sizes[: depth + 1])
                whole = np.empty(len(n), np.int64)
                whole[place] = np.repeat(np.add.reduceat(n[place], first), np.diff(np.append(first, len(n))))
            for k in range(depth, longest + 1):
                columns[k] = np.where(whole < least, blank, columns[k])
        place, first = _groups(columns, sizes)
        columns, n = [c[place[first]] for c in columns], np.add.reduceat(n[place], first)
        return pa.table([spoken.dictionary.take(pa.array(columns[0])), *[words.take(pa.array(c)) for c in columns[1:]], pa.array(n)], ["lang", *[f"w{i}" for i in range(1, longest + 1)], "n"])

    return merge


def frequencies(docs: DataFrame, longest: int = 3, least: int = 10, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, size, w1 .. wN, n): every phrase of up to ``longest`` words that occurs ``least`` times or
    more, with its frequency, unused words being null; and of size 0 the number of words of a language."""
    columns = [f"w{i}" for i in range(1, longest + 1)]
    given = docs.select(F.coalesce(docs[lang].cast("string"), F.lit("und")).alias("lang"), F.coalesce(docs[text], F.lit("")).alias("text"))
    buckets = BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = given.mapInArrow(_counter(longest, buckets), "lang string, bucket int, block string, ns array<int>")
    windows = blocks.groupBy("bucket").applyInArrow(_merger(longest, least), "lang string, " + ", ".join(f"{c} string" for c in columns) + ", n long")
    summed = windows.rollup("lang", *columns).agg(F.sum("n").alias("n"), F.bit_count(F.grouping_id()).alias("gone"))
    size = (F.lit(longest) - F.col("gone")).cast("int")
    ends = F.coalesce(*[F.when(F.col("size") == k, F.col(c) != "") for k, c in enumerate(columns, 1)], F.lit(True))
    sized = summed.filter(F.col("gone") <= longest).withColumn("size", size)
    return sized.filter(ends & ((F.col("size") == 0) | (F.col("n") >= least))).select("lang", "size", *columns, "n")


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exactly, for frequencies below 10^14."""
    wide = lambda c: c.cast("decimal(14,0)")
    above = wide(a) * wide(a) * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", above, wide(left) * wide(right))


def _with(phrases: DataFrame, known: DataFrame, begin: int, end: int, name: str) -> DataFrame:
    """Adds the frequency of the words ``begin`` to ``end`` of each phrase. A common word is asked for by many
    phrases, so single words and those who ask are dealt over slices."""
    keys = [f"w{i}" for i in range(begin, end + 1)]
    few = known.filter(F.col("size") == end - begin + 1).select("lang", *[F.col(f"w{i}").alias(k) for i, k in enumerate(keys, 1)], F.col("n").alias(name))
    if begin == end:
        few = few.withColumn("slice", F.explode(F.array(*[F.lit(s) for s in range(SLICES)])))
        keys.append("slice")
    return phrases.join(few, ["lang", *keys])


def candidates(known: DataFrame, longest: int = 3) -> DataFrame:
    """(lang, size, w1 .., a, k, l, r, score): phrases of two words and more at their worst cut."""
    found = None
    for size in range(2, longest + 1):
        words = [f"w{i}" for i in range(1, size + 1)]
        rows = known.filter(F.col("size") == size).withColumnRenamed("n", "a").withColumn("slice", F.pmod(F.xxhash64(*words), F.lit(SLICES)).cast("int"))
        for k in range(1, size):
            rows = _with(_with(rows, known, 1, k, f"l{k}"), known, k + 1, size, f"r{k}")
        cuts = [F.struct(score(F.col("a"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, size)]
        worst = F.array_min(F.array(*cuts))
        rows = rows.withColumn("cut", worst).select("lang", "size", *[f"w{i}" for i in range(1, longest + 1)], "a", "cut.k", "cut.l", "cut.r", "cut.score")
        found = rows if found is None else found.unionByName(rows)
    return found


def _inside(known: DataFrame, longest: int) -> DataFrame:
    """(lang, size, w1 .., over): phrases that lie in a longer one, with the largest frequency of such."""
    blank = F.lit(None).cast("string")
    parts = []
    for size in range(3, longest + 1):
        for part in range(2, size):
            for at in range(1, size - part + 2):
                parts.append(F.when(F.col("size") == size, F.struct(F.lit(part).alias("size"), *[(F.col(f"w{at + i}") if i < part else blank).alias(f"w{i + 1}") for i in range(longest)])))
    held = known.filter(F.col("size") > 2).select("lang", "n", F.explode(F.array_compact(F.array(*parts))).alias("p"))
    return held.select("lang", "p.*", "n").groupBy("lang", "size", *[f"w{i}" for i in range(1, longest + 1)]).agg(F.max("n").alias("over"))


def mine(known: DataFrame, longest: int = 3, share: int = 50, best: int = 2000) -> DataFrame:
    """The ``best`` phrases of each language out of the table of :func:`frequencies`: (lang, rank, phrase, a,
    l, r, n, score). A phrase goes where a longer one that holds it has ``share`` per cent of its frequency."""
    columns = [f"w{i}" for i in range(1, longest + 1)]
    rows = candidates(known, longest)
    if longest > 2:
        over = _inside(known, longest)
        same = F.lit(True)
        for c in ("lang", "size", *columns):
            same &= rows[c].eqNullSafe(over[c])
        kept = rows.join(over, same, "left").filter(F.coalesce(100 * over["over"] < share * rows["a"], F.lit(True)))
        rows = kept.select(*[rows[c] for c in rows.columns])
    named = rows.select("lang", F.concat_ws(" ", *columns).alias("phrase"), "a", "l", "r", "score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for keys in (["lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))], ["lang"]):
        named = named.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= best)
    words = known.filter(F.col("size") == 0).select("lang", "n")
    return named.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
