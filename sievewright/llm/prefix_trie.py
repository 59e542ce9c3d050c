"""Conversation prefix trie by parallel tree contraction.

Conversations that begin alike share the nodes of a trie. A node is known by a digest of its turns
that is summed (by exclusive or) over turns and their places, so that the digest of every prefix comes
from running sums, and the parent's digest from the node's own. Grouping nodes checks that all rows of
a node agree on its depth, parent and last turn, so nodes are equal exactly where sequences are.

Sums over subtrees come from contraction. Each round rakes the leaves into their parents and splices
out nodes of unary chains, no two of them neighbours: those whose depth has fewer trailing zero bits
than both neighbours, so that a chain halves each round. A spliced node leaves a note: its total is
that of the node below it plus a known sum. When only totals and notes remain, the notes are
shortened by pointer doubling until each leads to a raked node, which gives every total back. Rounds
grow with the logarithm of the tree's size, not with its depth.

Rows of one conversation may lie in several partitions. Places and running sums are taken within
partitions or blocks and completed by what earlier ones hold, so a conversation with a third of all
turns is not sorted in one task. Digests of members are made from sorted text blocks, read in order.

Odd input: rows without a conversation id belong to no conversation and play no part; a null turn
comes first; rows of equal turn are ordered by the digest of role and text; null role or text counts
as empty; repeated rows are turns of their own; an empty table gives no rows; texts of any length
count whole and are left behind before anything moves; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.llm.common import attach
from sievewright.session import Scratch

#: Places of a conversation that are summed within a task, before blocks are.
BLOCK = 1024
#: Members in one block of text.
MEMBERS = 4096
NO_PARENT = "-"


def ordered(turns: DataFrame, scratch: Scratch, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(c, p, d, bytes): each turn with its place in its conversation from 1, a digest of role and text, and
    the text's UTF-8 length. Turns are sorted in ranges; a range adds what earlier ones hold of its first
    conversation."""
    said, by = F.coalesce(turns[text].cast("string"), F.lit("")), F.coalesce(turns[role].cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(by).cast("string"), F.lit(":"), by, said).cast("binary"), 256)
    given = turns.select(turns[conv_id].cast("long").alias("c"), turns[turn].alias("at"), digest.alias("d"), F.octet_length(said).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row")).filter("c is not null")
    order = ["c", F.asc_nulls_first("at"), "d", "row"]
    lines = given.repartitionByRange(*order).sortWithinPartitions(*order)
    held = scratch.keep(lines.select("c", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("line"), "d", "bytes"))
    before = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = held.groupBy("c", "part").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("first")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return held.join(counts, ["c", "part"]).select("c", (F.col("before") + F.col("line") - F.col("first") + 1).alias("p"), "d", "bytes")


def _block(place: str) -> Column:
    return F.floor(F.col(place) / BLOCK).cast("long")


def crc_modulus(conv_id: Column, modulus: int) -> Column:
    """Unsigned crc32 of the decimal id, by a modulus."""
    return F.crc32(conv_id.cast("string").cast("binary")) % modulus


def rebuilt(turns: DataFrame, share: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Turns (c, p, d, bytes) and sizes (c, n) of conversations that begin as others do: the first h turns of
    conversation c - c % share, then c's own turns after its first h, where h is a hash below ``most``."""
    h = crc_modulus(F.col("c"), most)
    sizes = sizes_of(turns)
    base = sizes.select("c", h.alias("h"), (F.col("c") - F.col("c") % share).alias("b"))
    heads = turns.filter(F.col("p") < most).select(F.col("c").alias("b"), "p", "d", "bytes")
    first = base.join(heads, "b").filter(F.col("p") <= F.col("h")).select("c", "p", "d", "bytes")
    has = sizes.select(F.col("c").alias("b"), F.col("n").alias("has"))
    laid = sizes.join(base, "c").join(has, "b", "left").select("c", "n", "h", F.least(F.coalesce("has", F.lit(0)), "h").alias("lead"))
    blocks = laid.select("c", "h", "lead", F.explode(F.sequence(F.lit(0).cast("long"), _block("n"))).alias("block"))
    rest = turns.filter(F.col("p") > h).withColumn("block", _block("p")).join(blocks, ["c", "block"]).select("c", (F.col("p") - F.col("h") + F.col("lead")).alias("p"), "d", "bytes")
    return first.unionByName(rest), laid.select("c", (F.col("lead") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n"))


def _name(a: Column, b: Column) -> Column:
    return F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0"))


def members(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """(c, p, id, parent, d, bytes, ends): the node of each prefix of each conversation."""
    lanes = {x: F.xxhash64(F.lit(x), "p", "d") for x in ("a", "b")}
    cells = turns.withColumns(lanes).withColumn("block", _block("p"))
    within = Window.partitionBy("c", "block").orderBy("p")
    before = Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = cells.groupBy("c", "block").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    carry = blocks.select("c", "block", *[F.coalesce(F.bit_xor(x).over(before), F.lit(0)).alias(f"{x}0") for x in lanes])
    sums = cells.join(carry.join(sizes, "c"), ["c", "block"]).withColumns({f"{x}1": F.bit_xor(x).over(within).bitwiseXOR(F.col(f"{x}0")) for x in lanes})
    up = [F.col(f"{x}1").bitwiseXOR(F.col(x)) for x in lanes]
    nodes = sums.select("c", "p", _name(F.col("a1"), F.col("b1")).alias("id"), _name(*up).alias("parent"), "d", "bytes", (F.col("p") == F.col("n")).alias("ends"))
    zero = _name(F.lit(0).cast("long"), F.lit(0).cast("long"))
    root = sizes.select("c", F.lit(0).cast("long").alias("p"), zero.alias("id"), F.lit(NO_PARENT).alias("parent"), F.lit("").alias("d"), F.lit(0).cast("long").alias("bytes"), (F.col("n") == 0).alias("ends"))
    return nodes.unionByName(root)


def nodes(rows: DataFrame) -> DataFrame:
    """(id, parent, depth, conv_id, n_convs, bytes, n_children) of each node."""
    what = F.struct("p", "parent", "d")
    seen = rows.groupBy("id").agg(F.min(what).alias("low"), F.max(what).alias("high"), F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes"))
    depth = F.when(F.col("low") == F.col("high"), F.col("low.p")).otherwise(F.raise_error(F.lit("two sequences share a digest")))
    own = seen.select("id", F.col("low.parent").alias("parent"), depth.alias("depth"), "conv_id", "n_convs", "bytes")
    kids = own.groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    return own.join(kids, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))


def subtree_sums(tree: DataFrame, weights: list[str], scratch: Scratch) -> DataFrame:
    """(id, and each weight summed over the node's subtree) of a tree (id, parent, depth, n_children, weights)
    by parallel tree contraction. The root's parent is NO_PARENT.

    A live node holds its own sum so far (its weight and what was raked into it) and the sum of the nodes
    spliced out between it and its parent."""
    zero = F.lit(0).cast("long")
    own, gap = [f"own_{w}" for w in weights], [f"gap_{w}" for w in weights]
    zeros = lambda depth: F.bit_count(depth.bitwiseXOR(depth - 1))  # noqa: E731  trailing zero bits and one
    live = tree.select("id", "parent", "depth", "n_children", *[F.col(w).cast("long").alias(o) for w, o in zip(weights, own, strict=True)], *[zero.alias(g) for g in gap])
    live = scratch.keep(live.withColumn("parent_depth", F.greatest(F.col("depth") - 1, F.lit(0))))
    totals, notes = [], []
    while live.head(1):
        leaf = F.col("n_children") == 0
        totals.append(live.filter(leaf).select("id", *[F.col(o).alias(w) for w, o in zip(weights, own, strict=True)]))
        raked = [F.coalesce(F.sum(F.when(leaf, F.col(o) + F.col(g))), zero).alias(f"more_{o}") for o, g in zip(own, gap, strict=True)]
        below = F.when(~leaf, F.struct("depth", "id", *gap))
        kids = live.filter(F.col("parent") != NO_PARENT).groupBy(F.col("parent").alias("id")).agg(*raked, F.count(below).alias("left"), F.max(below).alias("below"))
        inner = live.filter(~leaf).join(kids, "id").withColumns({o: F.col(o) + F.col(f"more_{o}") for o in own})
        rank = lambda depth, name: F.struct(zeros(depth), name)
        mine = rank(F.col("depth"), F.col("id"))
        chosen = (F.col("left") == 1) & (F.col("parent") != NO_PARENT) & (mine < rank(F.col("below.depth"), F.col("below.id"))) & (mine < rank(F.col("parent_depth"), F.col("parent")))
        inner = scratch.keep(inner.withColumn("spliced", chosen).drop("n_children", *[f"more_{o}" for o in own]))
        gone = inner.filter("spliced")
        notes.append(gone.select("id", F.col("below.id").alias("below"), *[(F.col(f"below.{g}") + F.col(o)).alias(w) for w, o, g in zip(weights, own, gap, strict=True)]))
        moved = gone.select(F.col("below.id").alias("id"), F.col("parent").alias("up"), F.col("parent_depth").alias("up_depth"), *[(F.col(o) + F.col(g)).alias(f"add_{g}") for o, g in zip(own, gap, strict=True)])
        kept = inner.filter("not spliced").join(moved, "id", "left")
        live = scratch.keep(
            kept.select(
                "id", F.coalesce("up", "parent").alias("parent"), "depth", F.col("left").alias("n_children"), F.coalesce("up_depth", "parent_depth").alias("parent_depth"), *own,
                *[(F.col(g) + F.coalesce(f"add_{g}", zero)).alias(g) for g in gap],
            )
        )
    if not totals:
        return tree.select("id", *weights).limit(0)
    return _expanded(totals, notes, weights, scratch)


def _expanded(totals: list[DataFrame], notes: list[DataFrame], weights: list[str], scratch: Scratch) -> DataFrame:
    """Totals of raked nodes, and of spliced ones by following their notes, doubling their reach each round."""
    known = _all(totals)
    if not notes:
        return known
    left = scratch.keep(_all(notes))
    reach = 1
    while reach < len(notes):
        further = left.select(F.col("id").alias("below"), F.col("below").alias("next"), *[F.col(w).alias(f"add_{w}") for w in weights])
        left = scratch.keep(left.join(further, "below", "left").select("id", F.coalesce("next", "below").alias("below"), *[(F.col(w) + F.coalesce(f"add_{w}", F.lit(0))).alias(w) for w in weights]))
        reach *= 2
    ends = known.select(F.col("id").alias("below"), *[F.col(w).alias(f"add_{w}") for w in weights])
    found = left.join(ends, "below").select("id", *[(F.col(w) + F.col(f"add_{w}")).alias(w) for w in weights])
    return known.unionByName(found)


def _all(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the joined blocks of each node; blocks come sorted by node and place."""
    node, digest = None, None
    for batch in batches:
        names, sums = [], []
        for name, block in zip(batch["id"].to_pylist(), batch["block"].to_pylist(), strict=True):
            if name != node:
                if node is not None:
                    names.append(node)
                    sums.append(digest.hexdigest())
                node, digest = name, hashlib.sha256(block.encode())
            else:
                digest.update(b"," + block.encode())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sums, pa.string())], ["id", "ends_sha256"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([digest.hexdigest()])], ["id", "ends_sha256"])


def ends(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, ends_sha256): the digest of the ids of conversations that end at a node, ascending. Ids are
    sorted in ranges and joined to blocks of text there; only blocks of one node meet in one task, which
    reads them in order and keeps no more than the digest's state."""
    ids = rows.filter("ends").select("id", "c").repartitionByRange("id", "c").sortWithinPartitions("id", "c")
    held = scratch.keep(ids.select("id", "c", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("line")))
    block = F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c.cast("string")), ",")
    blocks = held.groupBy("id", "part", F.floor(F.col("line") / MEMBERS).alias("at")).agg(F.min("c").alias("first"), block.alias("block"))
    return blocks.select("id", "first", "block").repartition("id").sortWithinPartitions("id", "first").select("id", "block").mapInArrow(_digests, "id string, ends_sha256 string")


def sizes_of(turns: DataFrame) -> DataFrame:
    """(c, n): the number of turns of conversations as they are."""
    return turns.groupBy("c").agg(F.count(F.lit(1)).alias("n"))


def trie(turns: DataFrame, sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. Takes turns (c, p, d, bytes) and sizes (c, n), as :func:`ordered` and
    :func:`sizes_of`, or :func:`rebuilt`, give them."""
    rows = scratch.keep(members(turns, scratch.keep(sizes)))
    tree = scratch.keep(nodes(rows))
    weighed = tree.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("bytes"))
    sums = subtree_sums(weighed, ["n_leaves", "saved_tokens"], scratch)
    empty = hashlib.sha256(b"").hexdigest()
    parents = tree.filter("n_children > 0").select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("asking"))
    found = attach(tree, "parent", parents, "asking", F.col("id")).join(sums, "id").join(ends(rows, scratch), "id", "left")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))
