"""Merkle manifest of a table with a proof for every row, by pointer jumping. DataFrame functions alone.

1. ``leaves``: a digest per row. Leaves are sorted by tree (a value of one column) and order, and stored with their place.
2. ``build``: every run of ``FAN`` neighbours becomes a node, level by level, until each tree has one; these subroots, in the
   order of their trees, are the leaves of the top tree, whose last node is the root.
3. ``jump``: every inner node starts with its parent and the segment of siblings it has there. Each round joins the table
   with itself: a node takes over its ancestor's segments and its ancestor's ancestor, so the distance doubles and a
   tree of any depth takes the logarithm of its depth in rounds.
4. ``proofs``: the leaves, still in their runs, take over the segments of their parent, and so reach the root.

An ancestor at distance d has up to 8^d nodes below it. They are dealt over keys of about ``PER_KEY`` nodes; only the nodes
so far up are repeated for each key, so the repeats are fewer than the nodes / (8 PER_KEY).

Digests are SHA-256 in lower-case hexadecimal, of the texts of the inputs in a row. Defined results: a null field counts
as ``-``; a null in the tree's column is a tree of its own, before all others; rows without an order value come first; rows of
one order value are sorted by their digest, so equal rows are neighbours and each has its own proof; an empty table has no
leaves and no root (null).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

FAN = 8
PER_KEY = 512
TOP = "z"
NODES = "tree string, level int, pos long, at_tree string, at_level int, at_pos long, path array<struct<l: string, r: string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def row_digest(*fields: Column) -> Column:
    """Digest of a row: each field as its number of UTF-8 bytes, a colon and its text; ``-`` where it is null."""
    texts = [f.cast("string") for f in fields]
    return digest(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


def tree_key(value: Column) -> Column:
    """Name of a row's tree. In the order of bytes: null first, and all before ``TOP``."""
    return F.coalesce(F.concat(F.lit("b"), value.cast("string")), F.lit("a"))


def placed(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """Stored rows with ``pos``, their place from 0 within their tree, and ``total``, the tree's size.

    Sorted by range; a task's rows keep the place they are written in, and a table with a row per task and tree has the places before it.
    """
    held = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
    names = [tree, *order, "_row"]
    ranged = held.repartitionByRange(*(F.col(c).asc_nulls_first() for c in names)).sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in names))
    held = stored(ranged.withColumn("_at", F.monotonically_increasing_id()).drop("_row"), "sorted")
    held = held.withColumn("_part", F.shiftright("_at", 33))
    spans = held.groupBy("_part", tree).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    w = Window.partitionBy(tree)
    before = F.coalesce(F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select("_part", tree, (F.col("_first") - before).alias("_zero"), F.sum("_n").over(w).alias("total"))
    return held.join(spans, ["_part", tree]).withColumn("pos", F.col("_at") - F.col("_zero")).drop("_part", "_at", "_zero")


def levels_of(total: Column) -> Column:
    """Number of levels above ``total`` leaves: the least d with 8^d at least that."""
    return F.size(F.filter(F.sequence(F.lit(0), F.lit(20)), lambda k: F.pow(F.lit(float(FAN)), k.cast("double")) < total)).cast("int")


@dataclass
class Manifest:
    """runs: (tree, run, total, kids of pos, digest and payload), the leaves eight by eight. nodes: inner nodes (tree, level, pos) with their parent (at_tree, at_level, at_pos) and siblings to the left and right. root: its node and digest, None for an empty table. depth: steps from an inner node to the root, at most."""

    runs: DataFrame
    nodes: DataFrame
    root: tuple[str, int, int] | None
    root_digest: str | None
    depth: int


def _runs(nodes: DataFrame, *payload: str) -> DataFrame:
    """Neighbours of a level, eight by eight."""
    kid = F.struct("pos", "digest", *payload)
    return nodes.groupBy("tree", "total", F.floor(F.col("pos") / FAN).cast("long").alias("run")).agg(F.sort_array(F.collect_list(kid)).alias("kids"))


def _side(kids: Column, keep) -> Column:
    return F.array_join(F.transform(F.filter(kids, keep), lambda k: k["digest"]), "")


def _segment(kids: Column, pos: Column) -> Column:
    """Digests before and after a member of a run."""
    return F.struct(_side(kids, lambda k: k["pos"] < pos).alias("l"), _side(kids, lambda k: k["pos"] > pos).alias("r"))


def _parents(runs: DataFrame) -> DataFrame:
    """The next level: a node for every run."""
    size = F.ceil(F.col("total") / FAN).cast("long")
    return runs.select("tree", F.col("run").alias("pos"), size.alias("total"), F.sha2(_side(F.col("kids"), lambda k: F.lit(True)), 256).alias("digest"))


def _grown(nodes: DataFrame, level: int, most: int) -> tuple[DataFrame | None, DataFrame]:
    """From the nodes of a level, where the largest tree has ``most``: links of all nodes with their parents, and the last node of each tree (tree, level, digest)."""
    done, linked = None, None
    while True:
        last = nodes.where("total = 1").select("tree", F.lit(level).alias("level"), "digest")
        done = last if done is None else done.unionByName(last)
        if most <= 1:
            return linked, done
        runs = stored(_runs(nodes.where("total > 1")), "runs")
        kids = runs.select("tree", "run", "kids", F.explode("kids").alias("_k"))
        link = kids.select("tree", F.lit(level).alias("level"), F.col("_k.pos").alias("pos"), F.col("tree").alias("at_tree"), F.lit(level + 1).alias("at_level"), F.col("run").alias("at_pos"), F.array(_segment(F.col("kids"), F.col("_k.pos"))).alias("path"))
        linked = link if linked is None else linked.unionByName(link)
        nodes, level, most = _parents(runs), level + 1, -(-most // FAN)


def build(rows: DataFrame, order: Sequence[str], *payload: str) -> Manifest:
    """Manifest of ``rows(tree, digest, *order, *payload)``."""
    leaves = placed(rows.select("tree", "digest", *dict.fromkeys([*order, *payload])), "tree", *order, "digest")
    runs = stored(_runs(leaves, *payload), "leaves")
    most = runs.agg(F.max("total")).first()[0]
    if most is None:
        return Manifest(runs, runs.sparkSession.createDataFrame([], NODES), None, None, 0)
    alone = runs.where("total = 1").select("tree", F.col("kids")[0]["digest"].alias("digest"))
    linked, done = _grown(_parents(runs.where("total > 1")), 1, -(-most // FAN))
    subroots = stored(done.unionByName(alone.withColumn("level", F.lit(0))), "subroots")
    tops = placed(subroots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("of"), "level", "digest"), "tree", "of")
    width = subroots.count()
    depth = 0
    while FAN ** (depth + 1) < most:
        depth += 1
    if width == 1:
        only = subroots.first()
        parts, root, value = [linked], (only["tree"], only["level"], 0), only["digest"]
    else:
        runs_of_trees = stored(_runs(tops, "of", "level"), "trees")
        kids = runs_of_trees.select("run", "kids", F.explode("kids").alias("_k"))
        ends = kids.select(F.col("_k.of").alias("tree"), F.col("_k.level").alias("level"), F.lit(0).cast("long").alias("pos"), F.lit(TOP).alias("at_tree"), F.lit(1).alias("at_level"), F.col("run").alias("at_pos"), F.array(_segment(F.col("kids"), F.col("_k.pos"))).alias("path"))
        above, last = _grown(_parents(runs_of_trees), 1, -(-width // FAN))
        top = last.first()
        parts, root, value = [linked, ends, above], (TOP, top["level"], 0), top["digest"]
        depth += top["level"]
    nodes = runs.sparkSession.createDataFrame([], NODES)
    for part in parts:
        nodes = nodes if part is None else nodes.unionByName(part)
    return Manifest(runs, stored(nodes, "nodes"), root, value, depth)


def jump(manifest: Manifest, per_key: int = PER_KEY) -> DataFrame:
    """Nodes (tree, level, pos) with ``path``: the segments of siblings from the node to the root."""
    if manifest.root is None:
        return manifest.nodes.select("tree", "level", "pos", "path")
    at_root = (F.col("at_tree") == manifest.root[0]) & (F.col("at_level") == manifest.root[1])
    held, n, distance = manifest.nodes, manifest.nodes.count(), 1
    while distance < manifest.depth:
        keys = max(1, min(FAN**distance, n) // per_key)
        here = F.pmod(F.xxhash64("tree", "level", "pos"), F.lit(keys)).cast("int").alias("_s")
        far = held.where((F.col("level") > distance) | (F.col("tree") == TOP))  # no other node has one at this distance below it
        far = far.select(F.col("tree").alias("at_tree"), F.col("level").alias("at_level"), F.col("pos").alias("at_pos"), F.struct("at_tree", "at_level", "at_pos", "path").alias("_far"), F.explode(F.sequence(F.lit(0), F.lit(keys - 1))).alias("_s"))
        going = held.where(~at_root).withColumn("_s", here).join(far, ["at_tree", "at_level", "at_pos", "_s"])
        going = going.select("tree", "level", "pos", *(F.col(f"_far.{c}").alias(c) for c in ("at_tree", "at_level", "at_pos")), F.concat("path", F.col("_far.path")).alias("path"))
        held = stored(held.where(at_root).unionByName(going), "jumped")
        distance *= 2
    return held


def fold(leaf: Column, path: Column) -> Column:
    """Digest that a leaf and the segments of its siblings lead to."""
    return F.aggregate(path, leaf, lambda at, s: digest(s["l"], at, s["r"]))


def proofs(manifest: Manifest, *payload: str) -> DataFrame:
    """(*payload, leaf, path, levels, total): every leaf with its segments up to the root; the first ``levels`` lie inside its tree."""
    paths = jump(manifest).select("tree", "level", F.col("pos").alias("_pos"), F.col("path").alias("_above"))
    rows = manifest.runs.withColumns({"levels": levels_of(F.col("total")), "level": F.when(F.col("total") > 1, 1).otherwise(0), "_pos": F.when(F.col("total") > 1, F.col("run")).otherwise(F.lit(0))})
    met = rows.join(paths, ["tree", "level", "_pos"], "left").withColumn("_above", F.coalesce("_above", F.expr("cast(array() as array<struct<l: string, r: string>>)")))
    kids = met.select("kids", "_above", "levels", "total", F.explode("kids").alias("_k"))
    own = F.when(F.col("total") > 1, F.concat(F.array(_segment(F.col("kids"), F.col("_k.pos"))), F.col("_above"))).otherwise(F.col("_above"))
    return kids.select(*(F.col(f"_k.{c}").alias(c) for c in payload), F.col("_k.digest").alias("leaf"), own.alias("path"), "levels", "total")


def verified(docs: DataFrame, tampered: Column, changed: dict[str, Column], tree: str = "lang", order: str = "doc_id", fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text")) -> DataFrame:
    """A row per row of ``docs``: order, leaf, subroot, root, proof_sha256 of the table as it is; folded_root of the row as it is where ``tampered`` holds; verified."""
    of = lambda change: row_digest(*(change.get(c, F.col(c)) for c in fields))
    rows = docs.select(tree_key(F.col(tree)).alias("tree"), F.col(order), of({}).alias("digest"), F.when(tampered, of(changed)).alias("now"))
    manifest = build(rows, [order], order, "now")
    told = proofs(manifest, order, "now")
    whole = F.array_join(F.transform("path", lambda s: F.concat(s["l"], s["r"])), "")
    return told.select(
        order, "leaf", fold(F.col("leaf"), F.slice("path", F.lit(1), F.col("levels"))).alias("subroot"), F.lit(manifest.root_digest).cast("string").alias("root"),
        F.sha2(whole, 256).alias("proof_sha256"), fold(F.coalesce("now", "leaf"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
