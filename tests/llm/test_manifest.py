"""Merkle manifest: digests, proofs and tampering against a plain recursive version."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from voxelspan.llm import manifest
from voxelspan.llm.queries import op11_columns

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, digest int, leaf double"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def plain_tree(leaves):
    """(root, per leaf its list of (siblings before, siblings after))."""
    paths, level = [[] for _ in leaves], [([k], x) for k, x in enumerate(leaves)]
    while len(level) > 1:
        runs = [level[a : a + 8] for a in range(0, len(level), 8)]
        for run in runs:
            for k, (members, _) in enumerate(run):
                for m in members:
                    paths[m].append(("".join(d for _, d in run[:k]), "".join(d for _, d in run[k + 1 :])))
        level = [([m for members, _ in run for m in members], h(*(d for _, d in run))) for run in runs]
    return level[0][1], paths


def plain(rows):
    trees = {}
    for doc_id, text, lang, source, n_chars in rows:
        trees.setdefault("" if lang is None else "b" + lang, []).append((doc_id is not None, doc_id or 0, leaf_of(doc_id, source, lang, n_chars, text), (doc_id, source, lang, n_chars, text)))
    names = sorted(trees, key=lambda x: x.encode())
    held = {t: (sorted(trees[t], key=lambda r: r[:3]), None) for t in names}
    held = {t: (rows, plain_tree([r[2] for r in rows])) for t, (rows, _) in held.items()}
    root, tops = plain_tree([held[t][1][0] for t in names])
    out = []
    for k, t in enumerate(names):
        rows, (subroot, paths) = held[t]
        for (_, _, leaf, (doc_id, source, lang, n_chars, text)), path in zip(rows, paths, strict=True):
            whole = path + tops[k]
            bad = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
            at = leaf_of(doc_id, source, lang, n_chars, text.translate(LOWER)) if bad and text is not None else leaf
            for left, right in whole:
                at = h(left, at, right)
            out.append((doc_id, leaf, subroot, root, h(*(a + b for a, b in whole)), at, at == root))
    return out


def sized(n, langs, first=0):
    return [(first + k, f"Text Ä {k} No {k % 5}" if k % 2 else f"lower {k}", langs[k % len(langs)], f"s{k % 3}", k) for k in range(n)]


CASES = {
    "one row": [(5, "Aa", "en", None, 2)],
    "one tree, one run": sized(5, ["en"]),
    "one tree, a run of one at the end": sized(65, ["de"]),
    "lone leaves, many trees": sized(70, [f"l{k}é" for k in range(70)]),
    "uneven trees": sized(600, ["en"]) + sized(20, ["fr", None], 1000) + [(7777, "Z", "zz", "s", 1)],
    "odd rows": [(None, "A", None, None, None), (None, None, "en", "", 0), (3, "Same", "en", "x", 4), (3, "Same", "en", "x", 4), (3, "Other", "en", "x", 4), (9, "", "", "y", None), (6, "B" * 100_000, "en", "x", 1)],
}


@pytest.mark.parametrize("name", CASES)
def test_proofs_are_those_of_a_plain_tree(spark, name):
    rows = CASES[name]
    df = spark.createDataFrame([(*r, "clash", 1, 0.5) for r in rows], SCHEMA).repartition(3)
    found = op11_columns(df)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(plain(rows), key=key)


def test_empty_table(spark):
    assert op11_columns(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ancestors_dealt_over_keys(spark):
    """With one node a key the paths are the same."""
    rows = spark.range(700).select(F.lit("t").alias("tree"), F.sha2(F.col("id").cast("string"), 256).alias("digest"), "id")
    held = manifest.build(rows, ["id"], "id")
    a, b = (manifest.jump(held, n).orderBy("level", "pos").collect() for n in (1, 512))
    assert a == b and len(a) == 88 + 11 + 2
    ends = manifest.proofs(held, "id").select(manifest.fold(F.col("leaf"), F.col("path")).alias("end"), F.size("path").alias("n")).distinct().collect()
    assert [tuple(r) for r in ends] == [(held.root_digest, 4)]
