"""Near duplicates by SimHash: 64-bit fingerprints, linked where at most ``RADIUS`` bits differ.

1. ``fingerprints``: a bit is 1 where more than half the hashes of a text's word shingles, repeats included, have it.
2. ``links``: two fingerprints within the radius agree in at least ``pieces - RADIUS`` of ``pieces`` parts of their
   bits, so every choice of that many parts is a mask, and the masked bits name a shard. The members of a shard form a
   BK-tree: a child hangs below its parent at their distance, and a search for all within the radius of a fingerprint
   at distance d of a node goes on below the children at distances d - RADIUS to d + RADIUS alone.
3. The linked fingerprints grow into components by large and small stars.

A shard's tree meets the shard's searches in one task. Shards of more than ``BLOCK`` members are cut by a hash: each
block has a tree of its own, and every tree is sent to the tasks of all the shard's blocks, so no task holds more than
two blocks. Trees travel by the shuffle and not as broadcast variables, since together they are as large as the corpus.
The number of pieces follows the number of fingerprints, so that shards stay small; no choice loses a pair.

A task writes a star for each part of its shard that hangs together, not its pairs: copies and links within a
large group make rows in proportion to its members.

Defined results: a null or blank text has fingerprint zero and is linked like any other; a text of fewer words than a
shingle is one shingle; the component's id is the smallest doc_id in it; rows with a null doc_id have their fingerprint
and link others, but name no component (null where no other id is reached); repeated rows come out each for itself; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .near_dup import SALTS, components
from .shared import stored

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Members of a shard that share a tree.
BLOCK = 1024
#: Rows of one fingerprint from which its component is broadcast: at most (rows / HOT) of them.
HOT = 100_000
#: Up to so many fingerprints for each number of pieces; more take one piece more.
PIECES = {4: 2**24, 5: 2**33, 6: 2**64}
_SPACE = bytes.maketrans(b"\t\n\v\f\r", b"     ")


def shingle_hashes(text: bytes, width: int = SHINGLE, step: int = 65_536) -> Iterator[np.ndarray]:
    """Hashes of all word shingles of a text, ``step`` at a time."""
    import xxhash

    text = text.lower().translate(_SPACE)
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    text = text.strip(b" ")
    if not text:
        return
    gaps = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
    n = max(1, len(gaps) + 2 - width)
    starts = np.append(0, gaps + 1)[:n]
    ends = np.append(gaps, len(text))[-n:]
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, step):
        yield np.fromiter((digest(text[a:b], SEED) for a, b in zip(starts[at : at + step].tolist(), ends[at : at + step].tolist(), strict=True)), np.uint64)


def majority(hashes: list[np.ndarray], owner: list[int], n: int) -> np.ndarray:
    """Fingerprints of ``n`` texts from runs of hashes, each run of one text."""
    ones, total = np.zeros((n, 64), np.int64), np.zeros(n, np.int64)
    held, whose, size = [], [], 0

    def count() -> None:
        sizes = np.asarray([len(h) for h in held])
        bits = np.unpackbits(np.concatenate(held).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        np.add.at(ones, whose, np.add.reduceat(bits, np.cumsum(sizes) - sizes, axis=0, dtype=np.int64))
        np.add.at(total, whose, sizes)

    for h, k in zip(hashes, owner, strict=True):
        held.append(h)
        whose.append(k)
        size += len(h)
        if size >= 65_536:
            count()
            held, whose, size = [], [], 0
    if held:
        count()
    return np.packbits((2 * ones > total[:, None]).astype(np.uint8), axis=1, bitorder="little").view(np.uint64).reshape(n)


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint): one row per row of ``docs(doc_id, text)``, the 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            told = [(h, k) for k, t in enumerate(texts) for h in shingle_hashes(t or b"", width)]
            made = majority([h for h, _ in told], [k for _, k in told], len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made.view(np.int64))], ["doc_id", "fingerprint"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return given.mapInArrow(run, "doc_id long, fingerprint long")


class Forest:
    """BK-trees of several groups of distinct fingerprints, built level by level: at each step every member still on its way moves one edge down."""

    def __init__(self, group: np.ndarray, value: np.ndarray):
        """group: ascending numbers; the first member of a group is its root."""
        self.value = value
        first = np.flatnonzero(np.diff(group, prepend=-1))
        self.root = dict(zip(group[first].tolist(), first.tolist(), strict=True))
        at = np.repeat(first, np.diff(np.append(first, len(value))))
        moving = np.setdiff1d(np.arange(len(value)), first, assume_unique=True)
        keys, nodes = [], []
        while len(moving):
            key = at[moving] * 128 + np.bitwise_count(value[moving] ^ value[at[moving]])
            edge, lead, member = np.unique(key, return_index=True, return_inverse=True)
            keys.append(edge)
            nodes.append(moving[lead])
            at[moving] = moving[lead][member]
            moving = np.delete(moving, lead)
        #: parent * 128 + distance, ascending, and the child that hangs there.
        key, node = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, nodes))
        order = np.argsort(key)
        self.edge, self.child = key[order], node[order]

    def within(self, query: np.ndarray, at: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(number of the query, member) of all members within the radius of the queries, which start at the roots ``at``."""
        asked, found = np.arange(len(query)), []
        while len(asked):
            distance = np.bitwise_count(query[asked] ^ self.value[at]).astype(np.int64)
            hit = distance <= radius
            found.append((asked[hit], at[hit]))
            low = np.searchsorted(self.edge, at * 128 + np.maximum(distance - radius, 0))
            many = np.searchsorted(self.edge, at * 128 + distance + radius, "right") - low
            asked = np.repeat(asked, many)
            at = self.child[np.repeat(low - np.cumsum(many) + many, many) + np.arange(len(asked))]
        return tuple(np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in (0, 1))


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give the ends of each pair one label, the smallest; a label is the place of a member of its part."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        least = np.minimum(x, y)
        np.minimum.at(label, x, least)
        np.minimum.at(label, y, least)
        while (label[label] != label).any():
            label[:] = label[label]


def joined(group: np.ndarray, side: np.ndarray, value: np.ndarray, radius: int, pairs: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Stars (a, b) of the parts that hang together in each group. side 0: in the tree and searched for; 1: in the tree; 2: searched for. Rows come by group.

    ``pairs`` bounds the members that are looked at at a time, in the worst case.
    """
    label = np.arange(len(value))
    tree, ask = np.flatnonzero(side < 2), np.flatnonzero(side != 1)
    forest = Forest(group[tree], value[tree])
    sizes = np.bincount(group[tree], minlength=int(group.max()) + 1 if len(group) else 0)
    ask = ask[sizes[group[ask]] > 0]
    load = np.cumsum(sizes[group[ask]])
    at = 0
    while at < len(ask):
        to = max(at + 1, int(np.searchsorted(load, (load[at - 1] if at else 0) + pairs, "right")))
        part = ask[at:to]
        q, m = forest.within(value[part], np.asarray([forest.root[g] for g in group[part].tolist()]), radius)
        merge(label, part[q], tree[m])
        at = to
    far = np.flatnonzero(label != np.arange(len(value)))
    return value[far], value[label[far]]


def masks(n: int, radius: int = RADIUS) -> list[int]:
    """Masks of which any two fingerprints within the radius agree under one, for ``n`` fingerprints."""
    pieces = next(k for k, most in PIECES.items() if n <= most) - RADIUS + radius
    cuts = [64 * k // pieces for k in range(pieces + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(x) for x in combinations(parts, pieces - radius)]


def links(prints: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that connect the same fingerprints as all pairs within the radius. ``prints``: a stored column ``fingerprint`` of distinct values."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    keys = F.array(*(F.struct(F.lit(k).alias("mask"), F.col("fingerprint").bitwiseAND(F.lit(signed(x))).alias("key")) for k, x in enumerate(masks(prints.count(), radius))))
    rows = prints.select("fingerprint", F.explode(keys).alias("_k")).select("fingerprint", "_k.*")
    large = rows.groupBy("mask", "key").agg(F.count("*").alias("_n")).where(F.col("_n") > block)
    large = large.select("mask", "key", F.ceil(F.col("_n") / block).cast("int").alias("_blocks"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s"))
    own = F.pmod(F.xxhash64("fingerprint"), F.coalesce("_blocks", F.lit(1))).cast("int")
    cut = rows.withColumn("_s", F.pmod(F.xxhash64(F.lit(1), "fingerprint"), F.lit(SALTS)).cast("int")).join(large, ["mask", "key", "_s"], "left").withColumn("block", own)
    met = cut.withColumn("_other", F.explode(F.sequence(F.lit(0), F.coalesce("_blocks", F.lit(1)) - 1)))
    i, j = F.least("block", "_other"), F.greatest("block", "_other")
    side = F.when(i == j, 0).when(F.col("block") == i, 1).otherwise(2)
    names = ["mask", "key", "i", "j"]
    met = met.select("mask", "key", i.alias("i"), j.alias("j"), side.cast("int").alias("side"), "fingerprint").repartition(*names).sortWithinPartitions(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(rows: np.ndarray) -> pa.RecordBatch:
            group = np.cumsum((np.diff(rows[:, :4], axis=0, prepend=rows[:1, :4]) != 0).any(1))
            a, b = joined(group, rows[:, 4], rows[:, 5].copy().view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], ["a", "b"])

        held = np.zeros((0, 6), np.int64)
        for batch in batches:
            held = np.concatenate([held, np.stack([c.to_numpy().astype(np.int64) for c in batch.columns], axis=1)])
            whole = np.flatnonzero((held[:, :4] != held[-1:, :4]).any(1))
            if len(whole):
                yield told(held[: whole[-1] + 1])
                held = held[whole[-1] + 1 :]
        if len(held):
            yield told(held)

    return met.mapInArrow(run, "a long, b long").distinct()


def _least_of_class(members: DataFrame) -> DataFrame:
    """(fingerprint, component_id) of members (fingerprint, class, least); the members of one class are dealt over ``SALTS`` keys."""
    dealt = members.withColumn("_s", F.pmod(F.xxhash64("fingerprint"), F.lit(SALTS)))
    whole = dealt.groupBy("class", "_s").agg(F.min("least").alias("least")).groupBy("class").agg(F.min("least").alias("component_id"), F.collect_list("_s").alias("_s"))
    return dealt.join(whole.select("class", "component_id", F.explode("_s").alias("_s")), ["class", "_s"]).select("fingerprint", "component_id")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """(doc_id, fingerprint as 16 hexadecimal digits, component_id), one row per row of ``docs(doc_id, text)``."""
    rows = stored(fingerprints(docs, width), "simhash")
    prints = stored(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "fingerprints")
    grown = components(links(prints.select("fingerprint"), radius, block)).select(F.col("node").alias("fingerprint"), "class")
    grown = grown.union(grown.select("class", "class").distinct())  # the class's own node has no row
    linked = _least_of_class(prints.join(grown, "fingerprint"))
    known = stored(prints.join(linked, "fingerprint", "left").select("fingerprint", "n", F.coalesce("component_id", "least").alias("component_id")), "components")
    often = F.broadcast(known.where(F.col("n") > hot).drop("n"))  # at most a row for ``hot`` rows
    out = rows.join(often, "fingerprint").unionByName(rows.join(often, "fingerprint", "left_anti").join(known.where(F.col("n") <= hot).drop("n"), "fingerprint"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
