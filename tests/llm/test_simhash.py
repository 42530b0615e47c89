"""SimHash fingerprints, BK-trees and components against plain loops."""

import re

import numpy as np
import pytest
import xxhash

from voxelspan.llm import simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_print(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    told = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in told]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_components(prints, ids):
    """Smallest id that each row reaches, by trying all pairs."""
    label = list(range(len(prints)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    least = {}
    for k, name in enumerate(ids):
        if name is not None:
            least[root(k)] = min(least.get(root(k), name), name)
    return [least.get(root(k)) for k in range(len(prints))]


def check(spark, rows, **more):
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "doc_id long, text string, fingerprint string, component_id int")
    found = simhash.near_duplicates(df, **more)
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    prints = [plain_print(t) for _, t in rows]
    wanted = [(a, f"{p:016x}", c) for (a, _), p, c in zip(rows, prints, plain_components(prints, [a for a, _ in rows]), strict=True)]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(wanted, key=key)


def corpus(seed, n):
    rng = np.random.default_rng(seed)
    words = [f"W{k}é" if k % 7 == 0 else f"Word{k}" for k in range(300)]
    base = [list(rng.choice(words, rng.integers(1, 150))) for _ in range(n // 4)]
    out = []
    for k in range(n):
        text = list(base[k % len(base)])
        for _ in range(rng.integers(0, 3)):
            text[rng.integers(len(text))] = str(rng.choice(words))
        out.append(rng.choice([" ", "\n", "\t\v  ", "  "]).join(text))
    return out


def test_prints_of_odd_texts():
    texts = [None, "", " \t\n\v\f\r ", "one", "One  two", "ÄÖ x y z", "a b c", " a b", "a b c " * 5000, "\x1c x \x85 y z w"]
    for t in texts:
        runs = list(simhash.shingle_hashes((t or "").encode(), step=7))
        assert int(simhash.majority(runs, [0] * len(runs), 1)[0]) == plain_print(t)


@pytest.mark.parametrize("block", [3, 1024])
def test_components_are_those_of_all_pairs(spark, block):
    texts = corpus(1, 160)
    rows = [(k * 7 % 161, t) for k, t in enumerate(texts)] + [(500, None), (501, ""), (None, texts[0]), (None, None), (3, texts[1]), (3, texts[1]), (None, "alone " * 9)]
    check(spark, rows, block=block, hot=2)


def test_empty_table_has_no_rows(spark):
    check(spark, [])


def test_searches_follow_no_lost_edge():
    rng = np.random.default_rng(5)
    value = np.unique(rng.integers(0, 2**64, 40, dtype=np.uint64)[:, None] ^ (np.uint64(1) << rng.integers(0, 64, (40, 20)).astype(np.uint64)))
    rng.shuffle(value)
    group = np.sort(rng.integers(0, 3, len(value)))
    forest = simhash.Forest(group, value)
    ask = np.asarray([forest.root[g] for g in group])
    q, m = forest.within(value, ask, 3)
    wanted = {(a, b) for a in range(len(value)) for b in range(len(value)) if group[a] == group[b] and (int(value[a]) ^ int(value[b])).bit_count() <= 3}
    assert set(zip(q.tolist(), m.tolist(), strict=True)) == wanted and len(q) == len(wanted)


@pytest.mark.parametrize("n", [10, 2**25, 2**40])
def test_every_pair_within_the_radius_shares_a_mask(n):
    rng = np.random.default_rng(0)
    held = simhash.masks(n)
    for _ in range(2000):
        flip = sum(1 << int(k) for k in rng.choice(64, 3, replace=False))
        assert any(not flip & m for m in held)
