"""Prefix trie of conversations, its subtree sums by the Euler-tour technique.

A node is a distinct sequence of first turns; two 64-bit hashes of the sequence (the exclusive or
of its turns' hashes, each with its depth) name it, so a prefix's name follows from any piece of a
conversation and what came before it. Every node has an enter and an exit arc; an arc's successor
is the enter arc of the first child or next sibling, or an exit arc. The tour is list-ranked:
tasks contract the chains that lie within their rows, first those of a conversation's own nodes,
then pairs that a coin brings together, until few arcs are left; the contractions are then undone
with positions. A subtree's leaves and savings are differences of prefix sums at its two arcs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabforge.functions.topk import ranked
from tabforge.session import materialize

#: Turns of a conversation whose names are formed in one task, and positions of the tour that are summed in one.
STRETCH = 4096
#: Arcs that a task contracts at once; when no more are left, one task ranks them.
ARCS = 200_000
#: Conversation ids that are written together for a node's digest.
PACKED = 4096
_NODE = ["depth", "p1", "p2"]


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, t1, t2, bytes): turns in order (NULL first; ties by hashes of role and text).

    NULL roles and texts are empty; rows without conv_id belong to no conversation. A conversation's
    turns are ranked over all tasks, so none has to fit in one.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.xxhash64(F.lit(1), role, text).alias("t1"),
        F.xxhash64(F.lit(2), role, text).alias("t2"),
        F.octet_length(text).cast("long").alias("bytes"),
        F.monotonically_increasing_id().alias("row"),
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("t1"), F.col("t2"), F.col("row")]
    turns = materialize(ranked(turns, order).drop("turn", "row"))
    first = turns.groupBy("conv_id").agg(F.min("rank").alias("first"))
    return turns.join(first, "conv_id").select("conv_id", (F.col("rank") - F.col("first") + 1).alias("pos"), "t1", "t2", "bytes")


def plain(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns with their depths, and (conv_id, length) of every conversation."""
    return turns.withColumnRenamed("pos", "depth"), turns.groupBy("conv_id").agg(F.max("pos").alias("length"))


#: The contract's rebuilding: conversations of a family of FAMILY share up to SHARED - 1 first turns.
FAMILY, SHARED = 5, 9


def families(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every conversation c rebuilt: the first h turns of conversation c - c % FAMILY (all if fewer,
    none if absent), then its own after its first h; h = crc32(c) % SHARED."""
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    convs = convs.select("conv_id", "n", family.alias("family"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).alias("h"))
    heads = convs.select(F.col("conv_id").alias("family"), F.col("n").alias("there"))
    convs = convs.join(heads, "family", "left").withColumn("k", F.least("h", F.coalesce("there", F.lit(0))))
    convs = materialize(convs.select("conv_id", "family", "n", "h", "k"))
    first = turns.where(F.col("pos") < SHARED).withColumnRenamed("conv_id", "family")
    first = first.join(convs.where("k > 0").select("conv_id", "family", "k"), "family").where("pos <= k")
    own = turns.join(convs.select("conv_id", "h", "k"), "conv_id").where("pos > h")
    columns = ["conv_id", "depth", "t1", "t2", "bytes"]
    rows = first.withColumnRenamed("pos", "depth").select(columns)
    rows = rows.unionByName(own.withColumn("depth", F.col("k") + F.col("pos") - F.col("h")).select(columns))
    return rows, convs.select("conv_id", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))


def _paths(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv_id, depth, p1, p2, q1, q2, bytes, ends): the node that each conversation reaches at each
    depth, from the root, its parent's name, and whether the conversation ends there."""
    rows = rows.withColumn("stretch", F.floor((F.col("depth") - 1) / STRETCH).cast("long"))
    for k in (1, 2):
        rows = rows.withColumn(f"x{k}", F.xxhash64(F.lit(k), "depth", "t1", "t2"))
    within = Window.partitionBy("conv_id", "stretch").orderBy("depth")
    rows = rows.select("conv_id", "stretch", "depth", "bytes", "x1", "x2", *(F.bit_xor(f"x{k}").over(within).alias(f"p{k}") for k in (1, 2)))
    whole = rows.groupBy("conv_id", "stretch").agg(*(F.bit_xor(f"x{k}").alias(f"s{k}") for k in (1, 2)))
    before = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select("conv_id", "stretch", *(F.bit_xor(f"s{k}").over(before).alias(f"b{k}") for k in (1, 2))).where("stretch > 0")
    rows = rows.join(whole, ["conv_id", "stretch"], "left").join(lengths, "conv_id")
    name = [F.col(f"p{k}").bitwiseXOR(F.coalesce(f"b{k}", F.lit(0))) for k in (1, 2)]
    rows = rows.select(
        "conv_id",
        "depth",
        *(name[k - 1].alias(f"p{k}") for k in (1, 2)),
        *(name[k - 1].bitwiseXOR(F.col(f"x{k}")).alias(f"q{k}") for k in (1, 2)),
        "bytes",
        (F.col("depth") == F.col("length")).alias("ends"),
    )
    zero = F.lit(0).cast("long")
    roots = lengths.select("conv_id", *(zero.alias(c) for c in ("depth", "p1", "p2", "q1", "q2", "bytes")), (F.col("length") == 0).alias("ends"))
    return rows.unionByName(roots)


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains of arcs (arc, next, weight) within some rows become their first arc with the chain's weight
    and next (head NULL); the others get their chain's head and their distance from it as weight."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= ARCS:
            yield _contracted(held)
            held, size = [], 0
    if size:
        yield _contracted(held)


def _contracted(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    arc, after, weight = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("arc", "next", "weight"))
    order = np.argsort(arc)
    at = order[np.minimum(np.searchsorted(arc, after, sorter=order), len(arc) - 1)]
    here = arc[at] == after
    before = np.arange(len(arc))
    before[at[here]] = np.flatnonzero(here)
    first = before == np.arange(len(arc))
    distance = np.where(first, 0, weight[before])
    while not first[before].all():
        distance, before = distance + distance[before], before[before]
    last = ~here
    head = before[last]
    new_after, new_weight = after.copy(), distance.copy()
    new_after[head], new_weight[head] = after[last], distance[last] + weight[last]
    heads = pa.array(arc[before], mask=first)
    return pa.RecordBatch.from_arrays([pa.array(arc), pa.array(new_after), pa.array(new_weight), heads], ["arc", "next", "weight", "head"])


_ARC = "arc long, next long, weight long, head long"


def list_ranked(arcs: DataFrame, together: list[Column]) -> DataFrame:
    """(arc, pos) of a linked list (arc, next; -1 after the last one); pos counts from 0.

    ``together`` are columns whose equal rows are likely to follow each other. Tasks hold ARCS rows.
    """
    left = arcs.select("arc", "next", F.lit(1).cast("long").alias("weight"), *(c.alias(f"key{k}") for k, c in enumerate(together)))
    keys = [f"key{k}" for k in range(len(together))]
    rounds, turn = [], 0
    while True:
        done = materialize(left.repartition(*keys).sortWithinPartitions(*keys, "arc").select("arc", "next", "weight").mapInArrow(_contract, _ARC))
        rounds.append(done.where("head is not null").select("arc", "head", "weight"))
        left = done.where("head is null").select("arc", "next", "weight")
        if left.count() <= ARCS:
            break
        # an arc whose coin shows 1 goes to its successor, which is there if its own shows 0
        turn += 1
        coin = F.xxhash64("arc", F.lit(turn)).bitwiseAND(F.lit(1)) == 1
        left, keys = left.withColumn("key0", F.when(coin, F.col("next")).otherwise(F.col("arc"))), ["key0"]
    done = materialize(left.coalesce(1).mapInArrow(_contract, _ARC))
    known = done.select("arc", F.when(F.col("head").isNull(), 0).otherwise(F.col("weight")).alias("pos"))
    for hung in reversed(rounds):
        heads = known.select(F.col("arc").alias("head"), "pos")
        more = hung.join(heads, "head").select("arc", (F.col("pos") + F.col("weight")).alias("pos"))
        known = materialize(known.unionByName(more))
    return known


def _subtree_sums(nodes: DataFrame, tour: DataFrame) -> DataFrame:
    """(nid, leaves, saved) over each node's subtree: differences of prefix sums over the tour."""
    arcs = tour.select(F.shiftright("arc", 1).alias("nid"), (F.col("arc") % 2 == 1).alias("out"), "pos")
    arcs = arcs.join(nodes.select("nid", "leaf", "own"), "nid")
    arcs = arcs.withColumn("stretch", F.floor(F.col("pos") / STRETCH).cast("long"))
    within = Window.partitionBy("stretch").orderBy("pos")
    sums = {c: F.when(F.col("out"), 0).otherwise(F.col(c)) for c in ("leaf", "own")}
    arcs = arcs.select("nid", "out", "stretch", "leaf", "own", *(F.sum(v).over(within).alias(f"{c}_sum") for c, v in sums.items()))
    arcs = materialize(arcs)
    whole = arcs.groupBy("stretch").agg(*(F.max(f"{c}_sum").alias(c) for c in sums))
    before = Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)  # a row for every STRETCH arcs
    whole = whole.select("stretch", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in sums))
    arcs = arcs.join(whole, "stretch")
    total = lambda c: F.col(f"{c}_sum") + F.col(f"{c}_before")
    span = lambda c: F.max(F.when(F.col("out"), total(c))) - F.max(F.when(~F.col("out"), total(c) - F.col(c)))
    return arcs.groupBy("nid").agg(span("leaf").alias("n_leaves"), span("own").alias("saved_tokens"))


def _end_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ids of the conversations that end at each node, ascending, joined by commas.

    Ids are packed by PACKED in all tasks; the digest, which is sequential, then streams the packs.
    """
    rows = ranked(ends.select(*_NODE, "conv_id"), [F.col(c) for c in (*_NODE, "conv_id")])
    rows = rows.withColumn("pack", F.floor(F.col("rank") / PACKED).cast("long"))
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string"))
    packs = rows.groupBy(*_NODE, "pack").agg(F.array_join(ids, ",").alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha, done = None, None, []
        for batch in batches:
            for depth, p1, p2, ids in zip(*(batch.column(c).to_pylist() for c in (*_NODE, "ids")), strict=True):
                if (depth, p1, p2) != node:
                    if sha:
                        done.append((*node, sha.hexdigest()))
                    node, sha = (depth, p1, p2), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield _digests(done)
            done = []
        if sha:
            yield _digests([(*node, sha.hexdigest())])

    packs = packs.repartition(*_NODE).sortWithinPartitions(*_NODE, "pack")
    return packs.mapInArrow(digest, "depth long, p1 long, p2 long, ends_sha256 string")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*_NODE, "ends_sha256"])


def conversation_trie(conversations: DataFrame, rebuild=plain) -> DataFrame:
    """One row per node of the trie of ``conversations`` (conv_id, turn, role, text): conv_id (smallest
    member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``rebuild`` turns numbered turns into the conversations that are told apart. Turns are ordered by
    turn, NULL first, equal ones by a hash of role and text; NULL roles and texts are empty, so they
    equal empty ones; equal rows are turns of their own; rows of NULL conv_id are left out; other columns
    are not read. An empty table has no node. Prefixes are told apart by 128 bits of hash.
    """
    turns = materialize(numbered_turns(conversations))
    paths = materialize(_paths(*rebuild(turns)))
    grouped = paths.groupBy(*_NODE).agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("q1").alias("q1"), F.min("q2").alias("q2"), F.max("bytes").alias("bytes")
    )
    nodes = materialize(grouped.withColumn("nid", F.monotonically_increasing_id()))
    root = nodes.where("depth = 0").first()
    empty = hashlib.sha256(b"").hexdigest()
    if root is None:
        found = nodes.select("*", *(F.lit(0).cast("long").alias(c) for c in ("parent_conv_id", "n_children", "n_leaves", "saved_tokens")), F.lit(empty).alias("ends_sha256"))
        return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    # parents; the root's children, which may be most nodes, need no join
    top = nodes.where("depth = 1").select("nid", F.lit(root["nid"]).alias("parent"), F.lit(root["conv_id"]).alias("parent_conv_id"))
    above = nodes.where("depth > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("nid").alias("parent"), F.col("conv_id").alias("parent_conv_id")
    )
    deep = nodes.where("depth > 1").join(above, ["depth", "q1", "q2"]).select("nid", "parent", "parent_conv_id")
    links = materialize(ranked(top.unionByName(deep), [F.col("parent"), F.col("nid")]))
    kids = materialize(links.groupBy("parent").agg(F.min_by("nid", "rank").alias("child"), F.count("*").alias("n_children")))
    following = links.select((F.col("rank") - 1).alias("rank"), F.col("parent").alias("same"), F.col("nid").alias("sibling"))
    chained = links.join(following, "rank", "left").withColumn("sibling", F.when(F.col("parent") == F.col("same"), F.col("sibling")))
    known = nodes.join(kids.withColumnRenamed("parent", "nid"), "nid", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    known = materialize(known.join(chained.select("nid", "parent", "parent_conv_id", "sibling"), "nid", "left"))
    enter, leave = F.col("nid") * 2, F.col("nid") * 2 + 1
    arcs = known.select(
        "conv_id",
        "depth",
        F.inline(
            F.array(
                F.struct(enter.alias("arc"), F.coalesce(F.col("child") * 2, leave).alias("next")),
                F.struct(leave.alias("arc"), F.coalesce(F.col("sibling") * 2, F.col("parent") * 2 + 1, F.lit(-1)).alias("next")),
            )
        ),
    )
    tour = list_ranked(arcs, [F.col("conv_id"), F.floor(F.col("depth") / STRETCH)])
    weights = known.select("nid", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("own"))
    out = known.join(_subtree_sums(weights, tour), "nid").join(_end_digests(paths.where("ends")), _NODE, "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256")
    )
