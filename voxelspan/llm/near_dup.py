"""Near-duplicate classes by BagMinHash: weighted Jaccard of word-shingle multisets.

1. ``signatures``: per text the multiset of its 5-word shingles and a signature of ``SIZE`` values. Every shingle
   carries Poisson processes over the levels (0,1], (1,2], (2,4], (4,8] ... of its weight: points come in order of
   time, each with a place in the level and a component; a text with weight w takes the points up to w, and each
   component keeps the earliest one. Two texts share a component with the probability of their weighted Jaccard
   similarity. A process stops as soon as its next point is later than every component's.
2. Texts with equal words form one node, so copies are not compared.
3. ``BANDS`` bands of the signature give buckets. In each bucket every node is held against two hubs: the node with
   the most company in all its buckets, and the shortest one. Pairs whose signatures may reach the threshold are
   verified on their multisets, and links grow into classes by alternating large and small stars.
4. The rest, exactly: members of a bucket that are still in different classes are compared, in blocks of ``BLOCK``
   so that no task holds a bucket, by signature and then by multiset. Only links that join classes are written.

Nothing is capped. A pair of similarity 0.8 shares no band with probability 4.7e-8, and fails the signature
bound ``LEAST`` with less than 1e-6.

Defined results: texts without words (null, blank) are classes of their own; texts of fewer than five words have one
shingle; the class id is the smallest doc_id of the class; rows with equal doc_id are one document whose texts are
all linked; rows with a null doc_id take no part and have a null class; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_stored, stored

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 4
SIZE = BANDS * ROWS
LEAST = 0.62
BLOCK = 256
#: Keys over which the links of one node are dealt.
SALTS = 64
WORD = re.compile(r"[^\W_]+")
_GOLD, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of several texts: number of words of each, and for all shingles a 64-bit hash and their text's number."""
    words = [WORD.findall(t.lower()) for t in texts]
    sizes = np.asarray([len(w) for w in words], np.int64)
    flat = [x for w in words for x in w]
    if not flat:
        return sizes, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    code, distinct = pd.factorize(np.asarray(flat, dtype=object))
    h = pd.util.hash_array(np.asarray(distinct, dtype=object), categorize=False)[code]
    owner = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left = np.repeat(sizes, sizes) - place
    total = np.zeros(len(h), np.uint64)
    for k in range(SHINGLE):
        part = np.zeros(len(h), np.uint64)
        if k < len(h):  # a batch may have fewer words than a shingle
            part[: len(h) - k] = h[k:]
        part[left <= k] = 0  # only in texts shorter than a shingle does this matter
        total = mix(total * _GOLD + part + np.uint64(k + 1))
    keep = (left >= SHINGLE) | ((place == 0) & (np.repeat(sizes, sizes) < SHINGLE))
    return sizes, total[keep], owner[keep]


def bags(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) with their multiplicity: owner, hash, count."""
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(first)
    return o[at], h[at], np.diff(np.append(at, len(h)))


def bag_minhash(n: int, owner: np.ndarray, hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """(n, SIZE) 32-bit signatures of n multisets given by owner, hash and integer weight of their elements."""
    level = np.where(weights > 1, np.ceil(np.log2(np.maximum(weights, 1) - 0.5)), 0).astype(np.int64)  # the level in which the weight lies
    level = np.where((weights > 1) & (2.0**level < weights), level + 1, level)
    each = level + 1
    who = np.repeat(np.arange(len(owner)), each)
    lev = np.arange(len(who)) - np.repeat(np.cumsum(each) - each, each)
    low = np.where(lev == 0, 0.0, 2.0 ** (lev - 1))
    width = np.where(lev == 0, 1.0, low)
    state = mix(hashes[who] + (lev.astype(np.uint64) + np.uint64(1)) * _GOLD)
    own, most = owner[who], weights[who].astype(np.float64)
    t = np.zeros(len(who))
    best = np.full(n * SIZE, np.inf)
    r = 0
    while len(who):
        r += 1
        u = mix(state + np.uint64(r * int(_GOLD) % 2**64))
        t = t - np.log(((u >> np.uint64(24)).astype(np.float64) + 1.0) * 2.0**-40) / (width * SIZE)
        alive = t < best.reshape(n, SIZE).max(1)[own]
        t, u, state, own, low, width, most, who = (x[alive] for x in (t, u, state, own, low, width, most, who))
        inside = low + width * (((u >> np.uint64(7)) & np.uint64(0x1FFFF)).astype(np.float64) + 1.0) * 2.0**-17 <= most
        place = own[inside] * SIZE + (u[inside] & np.uint64(SIZE - 1)).astype(np.int64)
        np.minimum.at(best, place, t[inside])
    return (mix(best.view(np.uint64)) >> np.uint64(32)).astype(np.uint32).reshape(n, SIZE)


def bands_of(signature: np.ndarray) -> np.ndarray:
    """(n, BANDS) bucket keys."""
    x = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), x.shape[:2]) + np.uint64(1)
    for k in range(ROWS):
        out = mix(out * _GOLD + x[:, :, k])
    return out.view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n_words, signature): key is a 128-bit hash of the words in a row; texts without words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            names, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= 2_000_000 and to - at < 2_000):
                    size += len(texts[to])
                    to += 1
                sizes, hashes, owner = shingles(texts[at:to])
                sig = bag_minhash(to - at, *bags(hashes, owner))
                keys = [xxhash.xxh128_digest(" ".join(WORD.findall(t.lower()))) for t in texts[at:to]]
                rows = np.flatnonzero(sizes)
                yield pa.RecordBatch.from_arrays([
                    pa.array([names[at + k] for k in rows], pa.int64()), pa.array([keys[k] for k in rows], pa.binary()),
                    pa.array(sizes[rows]), pa.array([sig[k].tobytes() for k in rows], pa.binary())], ["doc_id", "key", "n_words", "signature"])
                at = to

    given = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return given.mapInArrow(run, "doc_id long, key binary, n_words long, signature binary")


def _bucketed(nodes: DataFrame) -> DataFrame:
    """(node, bucket) of all bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(-1, SIZE)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("node").to_numpy(), BANDS)), pa.array(bands_of(sig).reshape(-1))], ["node", "bucket"])

    return nodes.select("node", "signature").mapInArrow(run, "node long, bucket long")


def _may_match(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures agree in the share LEAST at least."""
    sig = nodes.select("node", "signature")
    rows = pairs.join(sig.withColumnsRenamed({"node": "a", "signature": "_x"}), "a").join(sig.withColumnsRenamed({"node": "b", "signature": "_y"}), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, SIZE) for c in ("_x", "_y"))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).mean(1) >= LEAST))

    return rows.select("a", "b", "_x", "_y").mapInArrow(run, "a long, b long")


def alike(a: tuple[np.ndarray, np.ndarray, int], b: tuple[np.ndarray, np.ndarray, int]) -> bool:
    """Whether two multisets (sorted elements, counts, total) reach the similarity."""
    (x, nx, n), (y, ny, m) = a, b
    if min(n, m) < SIMILARITY * max(n, m) or not n:
        return False
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    same = x[at] == y
    both = int(np.minimum(nx[at[same]], ny[same]).sum())
    return both >= SIMILARITY * (n + m - both)


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs whose multisets reach the similarity."""
    rows = pairs.join(texts.withColumnsRenamed({"node": "a", "text": "_x"}), "a").join(texts.withColumnsRenamed({"node": "b", "text": "_y"}), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[str, tuple[np.ndarray, np.ndarray, int]] = {}

            def bag(text: str) -> tuple[np.ndarray, np.ndarray, int]:
                if text not in held:
                    if len(held) > 200:
                        held.clear()
                    h = shingles([text])[1]
                    held[text] = (*np.unique(h, return_counts=True), len(h))
                return held[text]

            ok = []
            for a, b in zip(batch.column("_x").to_pylist(), batch.column("_y").to_pylist(), strict=True):
                ok.append(alike(bag(a), bag(b)))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return rows.select("a", "b", "_x", "_y").mapInArrow(run, "a long, b long").distinct()


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with ``m``, the least b of their a. The rows of one a are dealt over ``SALTS`` keys, so that a hub is not one task."""
    dealt = edges.withColumn("_s", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    part = dealt.groupBy("a", "_s").agg(F.min("b").alias("m"))
    whole = part.groupBy("a").agg(F.min("m").alias("m"), F.collect_list("_s").alias("_s"))  # at most SALTS rows of one a
    return dealt.join(whole.select("a", "m", F.explode("_s").alias("_s")), ["a", "_s"]).select("a", "b", "m")


def components(edges: DataFrame) -> DataFrame:
    """(node, class): smallest node of each connected component of edges (a, b), by large and small stars."""
    held = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        both = held.union(held.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()  # neighbours above go to the least
        ends = F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b"))))
        small = _with_least(large).select(ends.alias("_e")).select("_e.*")
        new = stored(small.where("a <> b").distinct(), "edges")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        drop_stored(held)
        held = new
        if now == mark:
            return held.select(F.col("a").alias("node"), F.col("b").alias("class"))
        mark = now


def _across(kept: DataFrame, classes: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between members of one bucket that are in different classes: within a block, only those that join classes there.

    A pair that shares several buckets is looked at in the first of them. The multisets are compared where the members meet, so no list of pairs arises.
    """
    known = kept.join(classes, "node", "left").select("bucket", "node", F.coalesce("class", "node").alias("class"))
    mixed = known.groupBy("bucket").agg(F.min("class").alias("_a"), F.max("class").alias("_b"), F.count("*").alias("_n")).where("_a <> _b").select("bucket", F.ceil(F.col("_n") / BLOCK).cast("int").alias("_blocks"))
    rows = known.join(mixed, "bucket").join(nodes.select("node", "signature"), "node").join(texts, "node")
    own = F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int")
    rows = rows.withColumn("block", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    names = ("bucket", "i", "j", "block", "node", "class", "signature", "text")
    rows = rows.withColumns({"i": F.least("block", "_other"), "j": F.greatest("block", "_other")}).select(*names)
    rows = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def compare(group: tuple, held: list[tuple]) -> list[tuple[int, int]]:
        bucket, i, j = group
        block, node, kind = (np.asarray([r[k] for r in held]) for k in (3, 4, 5))
        sig = np.frombuffer(b"".join(r[6] for r in held), np.uint32).reshape(-1, SIZE)
        keys = bands_of(sig)
        band = int(np.flatnonzero(keys[0] == bucket)[0])
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        bag: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}
        out = []

        def of(k: int) -> tuple[np.ndarray, np.ndarray, int]:
            if k not in bag:
                h = shingles([held[k][7]])[1]
                bag[k] = (*np.unique(h, return_counts=True), len(h))
            return bag[k]

        for a in left:
            other = right[(kind[right] != kind[a]) & ((node[right] > node[a]) | (i != j))]
            if len(other):
                other = other[(sig[other] == sig[a]).mean(1) >= LEAST]
                other = other[(keys[other] == keys[a]).argmax(1) == band]
            for b in other:
                if kind[a] != kind[b] and alike(of(a), of(b)):
                    out.append((int(max(node[a], node[b])), int(min(node[a], node[b]))))
                    kind[kind == kind[b]] = kind[a]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []

        def close() -> pa.RecordBatch:
            found = compare(group, held)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if row[:3] != group:
                    if held:
                        yield close()
                    group, held = row[:3], []
                held.append(row)
        if held:
            yield close()

    return rows.mapInArrow(run, "a long, b long").distinct()


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id) for every row of ``docs(doc_id, text)``."""
    signed = stored(signatures(docs), "signatures")
    keyed = signed.groupBy("key").agg(F.min("doc_id").alias("node"), F.min("n_words").alias("n_words"), F.min("signature").alias("signature"))
    nodes = stored(keyed, "nodes")
    bands = _bucketed(nodes)
    shared = bands.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    kept = stored(bands.join(shared, "bucket"), "buckets")
    company = kept.groupBy("node").agg(F.sum("n").alias("company")).join(nodes.select("node", "n_words"), "node")
    placed = kept.join(company, "node")
    hubs = placed.groupBy("bucket").agg(F.max_by("node", F.struct("company", -F.col("node"))).alias("_p"), F.min_by("node", F.struct("n_words", "node")).alias("_q"))
    pairs = kept.join(hubs, "bucket").select("node", F.explode(F.array("_p", "_q")).alias("hub")).where("node <> hub")
    pairs = pairs.select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b")).distinct()
    wanted = kept.select(F.col("node").alias("doc_id")).distinct()
    texts = stored(docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id", "left_semi").select(F.col("doc_id").alias("node"), "text"), "texts")
    often = signed.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    several = signed.join(often, "doc_id").select("doc_id", "key").join(nodes.select("key", "node"), "key").select("doc_id", "node")
    own = several.join(several.groupBy("doc_id").agg(F.min("node").alias("b")), "doc_id").where("node <> b").select(F.col("node").alias("a"), "b")  # texts of one id
    first = stored(_verified(_may_match(pairs, nodes), texts).union(own).distinct(), "links")
    found = components(first)
    found = components(first.union(_across(kept, found, nodes, texts)))
    named = nodes.select("key", "node").join(found, "node", "left").select("key", F.coalesce("class", "node").alias("class_id"))
    known = signed.select("doc_id", "key").join(named, "key").select("doc_id", "class_id").groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(known, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The document with the smallest id of every class, and all rows without an id.

    Of several rows with that id the one whose text has the smallest hash stays, of equal texts the one with the smallest hash of the row.
    """
    keep = classes(docs).where("doc_id = class_id").select("doc_id")
    of = F.struct(F.xxhash64("text").alias("t"), F.xxhash64(*docs.columns).alias("r"))
    kept = docs.join(keep, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), of).alias("_row")).select("_row.*")
    return kept.unionByName(docs.where("doc_id is null"))
