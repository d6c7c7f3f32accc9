"""MinHash near-dedup with HyperMinHash registers.

A document's distinct shingles fall into buckets by their hash; a bucket's register keeps the
leading-zero count of its smallest hash and a few mantissa bits. Empty buckets of small sets
borrow another's register by a fixed rule. Bands of registers propose candidates, the
collision-corrected estimate of Jaccard similarity sorts out what cannot reach the threshold,
and links are confirmed on the full sets.

Copies of a set are one node. In a band's bucket every member is first held against the
smallest; after the components of those links, buckets that still hold several components
are compared across them, in blocks, until nothing that could link is left untested.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.functions.topk import ranked
from tabforge.llm import words as W
from tabforge.llm.batches import bounded
from tabforge.llm.components import connected_components
from tabforge.session import materialize

SHINGLE, THRESHOLD = 5, 75
REGISTERS, ROWS, MANTISSA = 128, 4, 10
#: Members of a bucket that travel together (a power of two), and the bytes of their full sets.
BLOCK, BLOCK_BYTES = 512, 1 << 22
#: Standard deviations below the threshold at which an estimate rules a pair out.
SIGMAS = 5.2


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes; with fewer than SHINGLE words, one of them all."""
    h = W.hashes(W.split(text, lower=True))
    if not len(h):
        return h
    # a short text's shingle also carries its length, so it equals no longer text's
    return np.unique(W.windows(h, min(SHINGLE, len(h))) + np.uint64(max(0, SHINGLE - len(h))))


def registers(hashes: np.ndarray) -> np.ndarray:
    """REGISTERS 16-bit registers (leading zeros above MANTISSA bits) of a set's sorted hashes."""
    bits = REGISTERS.bit_length() - 1
    bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    fraction, exponent = np.frexp(np.maximum(hashes[first] << np.uint64(bits), 1).astype(np.float64))
    zeros = np.clip(64 - exponent, 0, 63).astype(np.uint16)
    register = (zeros << np.uint16(MANTISSA)) | ((fraction * 2 - 1) * (1 << MANTISSA)).astype(np.uint16)
    out, have = np.zeros(REGISTERS, np.uint16), np.zeros(REGISTERS, bool)
    out[bucket[first]], have[bucket[first]] = register, True
    left, turn = np.flatnonzero(~have), 1
    while len(left):
        donor = (W.mix(left.astype(np.uint64) << np.uint64(32) | np.uint64(turn)) >> np.uint64(64 - bits)).astype(np.int64)
        got = have[donor]
        out[left[got]] = out[donor[got]]
        left, turn = left[~got], turn + 1
    return out


#: Chance that two different minima give equal registers, about: equal zeros (1/3) and mantissa.
COLLISION = 1 / (3 << MANTISSA)


def estimate(equal: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of equal registers, without the collisions."""
    return np.maximum(0, (equal - COLLISION) / (1 - COLLISION))


def least_estimate(sizes: np.ndarray) -> np.ndarray:
    """Below this a pair whose smaller set has so many shingles isn't tested; small sets always are."""
    j = THRESHOLD / 100
    return j - SIGMAS * np.sqrt(j * (1 - j) / np.minimum(REGISTERS, np.maximum(sizes, 1) / 2))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < THRESHOLD * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int(np.count_nonzero(b[at] == a))
    return 100 * both >= THRESHOLD * (len(a) + len(b) - both)


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n (set size), same (128-bit digest of the set) and registers of every row; NULL for empty sets."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("same", pa.binary()), ("regs", pa.binary())])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, same, regs = [], [], []
            for text in batch.column(1):
                hashes = shingles(text.as_py())
                sizes.append(len(hashes))
                same.append(_digest(hashes) if len(hashes) else None)
                regs.append(registers(hashes).tobytes() if len(hashes) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(same, pa.binary()), pa.array(regs, pa.binary())], schema=schema
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(sketch, "id long, n long, same binary, regs binary")


def _sets(texts: DataFrame) -> DataFrame:
    """(node, n, regs, hashes) of the rows (node, same, text) whose text has that digest."""
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("regs", pa.binary()), ("hashes", pa.binary())])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for node, same, text in zip(*batch.columns, strict=True):
                hashes = shingles(text.as_py())
                if _digest(hashes) == same.as_py():
                    rows.append({"node": node.as_py(), "n": len(hashes), "regs": registers(hashes).tobytes(), "hashes": hashes.tobytes()})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return texts.select("node", "same", "text").mapInArrow(sets, "node long, n long, regs binary, hashes binary")


def _digest(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def _possible(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b, a_n, b_n, a_regs, b_regs) whose estimate doesn't rule them out."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("a_regs", "b_regs"))
                sizes = np.minimum(batch.column("a_n").to_numpy(), batch.column("b_n").to_numpy())
                possible = estimate((a == b).mean(axis=1)) >= least_estimate(sizes)
                yield batch.select(["a", "b"]).filter(pa.array(possible))

    return pairs.mapInArrow(keep, "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked by their full sets."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [[np.frombuffer(x.as_py(), np.uint64) for x in batch.column(c)] for c in ("a_hashes", "b_hashes")]
            ok = pa.array([linked(x, y) for x, y in zip(*sides, strict=True)], pa.bool_())
            yield batch.select(["a", "b"]).filter(ok)

    a = sets.select(F.col("node").alias("a"), F.col("hashes").alias("a_hashes"))
    b = sets.select(F.col("node").alias("b"), F.col("hashes").alias("b_hashes"))
    return pairs.join(b, "b").join(a, "a").mapInArrow(confirm, "a long, b long")


def _bands(reps: DataFrame) -> DataFrame:
    """(band key, node): the key hashes the band's number and its registers."""
    keys = F.transform(
        F.sequence(F.lit(0), F.lit(REGISTERS // ROWS - 1)),
        lambda k: F.xxhash64(k, F.substring("regs", k * (2 * ROWS) + 1, F.lit(2 * ROWS))),
    )
    return reps.select("node", F.explode(keys).alias("key"))


class _Members:
    """Members of a packed block: a list of structs (node, comp, n, regs and, at last, hashes)."""

    def __init__(self, column: pa.Array):
        self.offsets = column.offsets.to_numpy()
        held = column.values
        self.node, self.comp, self.n = (held.field(c).to_numpy(zero_copy_only=False) for c in ("node", "comp", "n"))
        self.regs = np.frombuffer(b"".join(held.field("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        self.hashes = held.field("hashes") if held.type.get_field_index("hashes") >= 0 else None

    def at(self, k: int) -> slice:
        return slice(self.offsets[k], self.offsets[k + 1])


def _candidates(key: int, regs: np.ndarray, comp: np.ndarray, n: np.ndarray, first: int | None) -> tuple[np.ndarray, ...]:
    """(similarity, i, j) of the pairs of different components that the estimate allows and whose first
    common band is the bucket's: all pairs, or those of the ``first`` members with the others."""
    bands = np.ascontiguousarray(regs).view(np.uint64).reshape(len(regs), -1)
    own = [k for k in range(bands.shape[1]) if _band_key(k, regs[0]) == key][0]
    found = []
    for i in range(len(regs) if first is None else first):
        start = i + 1 if first is None else first
        js = start + np.flatnonzero(comp[start:] != comp[i])
        similar = estimate((regs[js] == regs[i]).mean(axis=1))
        possible = similar >= least_estimate(np.minimum(n[js], n[i]))
        if own:
            possible &= ~(bands[js, :own] == bands[i, :own]).any(axis=1)
        if possible.any():
            js = js[possible]
            found.append((similar[possible], np.full(len(js), i), js))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0), *[np.zeros(0, np.int64)] * 2)


def _tested(batch: pa.RecordBatch) -> Iterator[tuple]:
    """For every pair of blocks in ``batch`` (or block alone): its row, members put together, and candidates."""
    a, b = _Members(batch.column("a")), _Members(batch.column("b"))
    for k, key in enumerate(batch.column("key").to_pylist()):
        one, two = a.at(k), b.at(k)
        parts = [np.concatenate((getattr(a, c)[one], getattr(b, c)[two])) for c in ("node", "comp", "n", "regs")]
        node, comp, n, regs = parts
        alone = two.start == two.stop
        yield k, one, two, a, b, node, comp, _candidates(key, regs, comp, n, None if alone else one.stop - one.start)


def _involved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, block, nodes) of the members that are in a candidate pair."""
    for batch in batches:
        keys, i, j = (batch.column(c).to_pylist() for c in ("key", "i", "j"))
        rows = []
        for k, one, _, _, _, node, _, (_, left, right) in _tested(batch):
            size = one.stop - one.start
            used = np.unique(np.concatenate((left, right)))
            rows += [(keys[k], block, node[some].tolist()) for block, some in ((i[k], used[used < size]), (j[k], used[used >= size])) if len(some)]
        columns = list(zip(*rows, strict=True)) or [[]] * 3
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["key", "block", "nodes"])


def _links_across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): links found between components by full sets, as many as join them."""
    for batch in batches:
        links: list[tuple[int, int]] = []
        for _, one, two, a, b, _, comp, (similar, left, right) in _tested(batch):
            hashes = [np.frombuffer(h.as_py(), np.uint64) for m, part in ((a, one), (b, two)) for h in m.hashes[part.start : part.stop]]
            root: dict[int, int] = {}

            def find(x: int, root: dict[int, int] = root) -> int:
                while root.get(x, x) != x:
                    x = root[x]
                return x

            for p in np.argsort(-similar, kind="stable").tolist():
                i, j = int(left[p]), int(right[p])
                x, y = find(int(comp[i])), find(int(comp[j]))
                if x != y and linked(hashes[i], hashes[j]):
                    root[max(x, y)] = min(x, y)
                    links.append((x, y))
        columns = list(zip(*links, strict=True)) or [[]] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])


def _band_key(band: int, regs: np.ndarray) -> int:
    """Spark's xxhash64 of (int, binary), seed 42, as _bands has it."""
    seed = xxhash.xxh64_intdigest(int(band).to_bytes(4, "little"), seed=42)
    value = xxhash.xxh64_intdigest(regs[band * ROWS : (band + 1) * ROWS].tobytes(), seed=seed)
    return value - (1 << 64) if value >> 63 else value


def _second_look(bands: DataFrame, sets: DataFrame, comps: DataFrame) -> DataFrame:
    """Links (a, b) between components that share a bucket; every pair that could link is tested.

    A bucket's members, in order of size class (sets of more than twice the size can't link) and
    component, are cut into blocks of bounded bytes. A block travels as one row, and pairs of blocks
    meet, not pairs of members: those of neighbouring classes that aren't of one and the same component.
    """
    member = bands.join(comps, bands["node"] == comps["member"], "left").select("key", "node", F.coalesce("root", "node").alias("comp"))
    mixed = member.groupBy("key").agg(F.count("*").alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    # two members were held against each other already
    member = member.join(mixed.where("m > 2 and lo <> hi").select("key"), "key").join(sets.select("node", "n"), "node")
    member = member.select("key", "node", "comp", F.floor(F.log2("n")).cast("int").alias("class"))
    member = ranked(member, [F.col(c) for c in ("key", "class", "comp", "node")])
    # at most BLOCK members and, as sets of a class have under 16 << class bytes, BLOCK_BYTES or one set
    shift = F.least(F.lit(BLOCK.bit_length() - 1), F.greatest(F.lit(0), F.lit(BLOCK_BYTES.bit_length() - 5) - F.col("class")))
    block = F.call_function("shiftright", "rank", shift).bitwiseOR(F.call_function("shiftleft", F.col("class").cast("long"), F.lit(56)))
    member = materialize(member.select("key", "node", "comp", "class", block.alias("block")))
    blocks = member.groupBy("key", "class", "block").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    side = lambda s: blocks.select("key", *(F.col(c).alias(f"{s}_{c}") for c in ("class", "block", "lo", "hi")))
    pairs = side("i").join(side("j"), "key").where("i_block <= j_block and j_class - i_class <= 1 and (i_lo <> i_hi or j_lo <> j_hi or i_lo <> j_lo)")
    pairs = materialize(pairs.select("key", F.col("i_block").alias("i"), F.col("j_block").alias("j")))

    def packed(members: DataFrame, columns: list[str]) -> DataFrame:
        """(key, i, j, a, b): the members of both blocks; b is empty where a block meets itself."""
        rows = members.join(sets.select("node", *columns), "node")
        rows = materialize(rows.groupBy("key", "block").agg(F.collect_list(F.struct("node", "comp", *columns)).alias("members")))
        of = lambda s, m: rows.select("key", F.col("block").alias(s), F.col("members").alias(m))
        alone = pairs.where("i = j").join(of("i", "a"), ["key", "i"]).select("key", "i", "j", "a", F.slice("a", 1, 0).alias("b"))
        two = pairs.where("i < j").join(of("i", "a"), ["key", "i"]).join(of("j", "b"), ["key", "j"]).select("key", "i", "j", "a", "b")
        return alone.unionByName(two)

    used = packed(member, ["n", "regs"]).mapInArrow(_involved, "key long, block long, nodes array<long>")
    used = used.groupBy("key", "block").agg(F.array_distinct(F.flatten(F.collect_list("nodes"))).alias("nodes"))
    used = used.select("key", "block", F.explode("nodes").alias("node"))
    used = materialize(used.join(member.select("key", "block", "node", "comp"), ["key", "block", "node"]))
    return packed(used, ["n", "regs", "hashes"]).mapInArrow(_links_across, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept.

    A-Z are lower-cased; shingles are SHINGLE words. Links need 100 * common >= 75 * all shingles.
    NULL texts and texts without words have no shingles, link with nothing and are kept. Rows with
    the same id are one document for links; a NULL id links with nothing, has a NULL component and
    is kept. An empty table gives an empty result. Two texts at the threshold share no band with a
    chance of about 5 in a million; all that share one are tested.
    """
    rows = materialize(sketches(bounded(docs), id_col, text_col))
    solid = rows.where("n > 0 and id is not null")
    # a node for each different set, and one of its documents
    nodes = materialize(solid.groupBy("same").agg(F.min("id").alias("least")).withColumn("node", F.monotonically_increasing_id()))
    reps = solid.join(nodes, "same").where("id = least").dropDuplicates(["node"]).select("node", "n", "regs")
    reps = materialize(reps)
    bands = materialize(_bands(reps))
    hubs = bands.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("m")).where("m > 1")
    shared = materialize(bands.join(hubs, "key"))
    pairs = shared.where("a <> node").select("a", F.col("node").alias("b")).distinct()

    def side(s: str) -> DataFrame:
        return reps.select(F.col("node").alias(s), F.col("n").alias(f"{s}_n"), F.col("regs").alias(f"{s}_regs"))

    pairs = materialize(_possible(pairs.join(side("b"), "b").join(side("a"), "a")))
    # full sets, once, of those in a pair and of those that may be compared again
    asked = shared.where("m > 2").select("node").union(pairs.select("a")).union(pairs.select("b")).distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("least"), F.col(text_col).alias("text"))
    sets = materialize(_sets(texts.join(nodes.join(asked, "node"), "least")).dropDuplicates(["node"]))
    links = materialize(_confirmed(pairs, sets))
    roots = connected_components(links)
    more = materialize(_second_look(shared.select("key", "node"), sets, roots.withColumnRenamed("node", "member")))
    # rows that share an id join their sets
    own = solid.select("id", "same").join(nodes, "same")
    twice = own.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z")
    joined = own.join(twice, "id").where("node <> a").select("a", F.col("node").alias("b"))
    # the stars found so far stand for their links
    roots = connected_components(roots.toDF("a", "b").union(more).union(joined))
    rooted = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("same", "component_id")
    out = rows.join(named, "same", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    out = out.withColumn("component_id", component)
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )
