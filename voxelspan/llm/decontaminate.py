"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are lower-cased and reduced to words with one space around each. An item of m characters may
differ by k = floor(``RATE`` * m) edits. Cut into k + s pieces, it keeps at least s whole wherever it occurs within k
edits, and the starts that these imply differ by k at most, so an automaton over all pieces finds every place worth a
look: a span of k starts with s different pieces. s is such that a piece has about ``PIECE`` characters, 1 at least.
Overlapping stretches of text around such spans are joined and read once by Myers' bit-parallel algorithm for the
smallest distance of the item to any part of them; a stretch never exceeds the text, however often a piece recurs.
Where one string is more than ``REPEATED`` pieces of an item, each of its hits is worth a look, and only the range of
the starts it implies is kept, so a repetitive item in a repetitive text costs no list of pieces and hits.

The items go to the tasks in blocks of about ``BLOCK_CHARS`` characters, by a hash of id and text, each held against all
documents.

Defined results: null or blank texts and items match nothing; of several places of an item in a text the one with the
smallest distance, then the first end, counts; items with the same text are reported each; repeated rows are searched
each for itself; an empty table gives no rows; further columns are ignored by ``matches`` and kept by ``clean``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE = 0.1
PIECE = 8
REPEATED = 4
BLOCK_CHARS = 8_000_000
WORD = re.compile(r"[^\W_]+")
MATCHES = "doc_id long, item_id long, distance int, n_chars int, end int"


def normal(text: str | None) -> str:
    """Lower-case words with one space around each; empty without words."""
    words = WORD.findall((text or "").lower())
    return f" {' '.join(words)} " if words else ""


def budget(item: str, rate: float = RATE) -> int:
    return int(rate * len(item))


def pieces(item: str, k: int, s: int = 1) -> list[tuple[int, str]]:
    """k + s pieces of nearly equal length, with their place in the item."""
    cuts = [len(item) * i // (k + s) for i in range(k + s + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def wanted(item: str, k: int) -> int:
    """How many pieces besides k the item is cut into."""
    return max(1, len(item) // PIECE - k)


def myers(item: str, text: str, k: int) -> tuple[int, int] | None:
    """Smallest distance of ``item`` to any part of ``text`` and the first end of such a part; None if above k."""
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << len(item)) - 1, 1 << (len(item) - 1)
    up, down, score, best = full, 0, len(item), None
    get = masks.get
    for j, c in enumerate(text):
        eq = get(c, 0)
        x = eq | down
        d = ((((eq & up) + up) ^ up) | eq) | down
        h_up = down | ~(d | up) & full
        h_down = up & d
        if h_up & top:
            score += 1
        elif h_down & top:
            score -= 1
        h_up = h_up << 1 & full
        h_down = h_down << 1 & full
        up = (h_down | ~(x | h_up)) & full
        down = h_up & x
        if score <= k and (best is None or score < best[0]):
            best = score, j + 1
            if score == 0:
                break
    return best


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping (left, right) joined."""
    out: list[tuple[int, int]] = []
    for left, right in sorted(spans):
        if out and left <= out[-1][1]:
            out[-1] = out[-1][0], max(right, out[-1][1])
        else:
            out.append((left, right))
    return out


def stretches(found: list[tuple[int, int]], k: int, s: int, m: int) -> list[tuple[int, int]]:
    """(left, right) of the stretches around spans of k implied starts with s different pieces; found: (implied start, piece)."""
    found.sort()
    out: list[tuple[int, int]] = []
    held: dict[int, int] = {}
    first = 0
    for start, piece in found:
        held[piece] = held.get(piece, 0) + 1
        while found[first][0] < start - k:
            gone = found[first][1]
            held[gone] -= 1
            if not held[gone]:
                del held[gone]
            first += 1
        if len(held) >= s:
            out.append((max(0, found[first][0] - k), start + m + k))
    return joined(out)


class Finder:
    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = [(i, t, k, wanted(t, k)) for i, t in items for k in [budget(t, rate)]]
        held: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, k, s) in enumerate(self.items):
            for at, piece in pieces(text, k, s):
                held.setdefault(piece, []).append((n, at + len(piece)))
        self.automaton = ahocorasick.Automaton()
        for piece, where in held.items():
            by: dict[int, list[int]] = {}
            for n, ahead in where:
                by.setdefault(n, []).append(ahead)
            once = [(n, a) for n, aheads in by.items() if len(aheads) <= REPEATED for a in aheads]
            often = [(n, min(a), max(a)) for n, a in by.items() if len(a) > REPEATED]
            self.automaton.add_word(piece, (once, often))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, distance, length, end) for each item within its budget somewhere in the normal text."""
        hits: dict[int, list[tuple[int, int]]] = {}
        spans: dict[int, list[tuple[int, int]]] = {}
        for end, (once, often) in self.automaton.iter(text):
            for n, ahead in once:
                hits.setdefault(n, []).append((end + 1 - ahead, ahead))
            for n, low, high in often:  # ends come in order, so a range can only meet the last one
                _, item, k, _ = self.items[n]
                left, right = max(0, end + 1 - high - k), end + 1 - low + len(item) + k
                own = spans.setdefault(n, [])
                if own and left <= own[-1][1]:
                    own[-1] = min(left, own[-1][0]), max(right, own[-1][1])
                else:
                    own.append((left, right))
        out = []
        for n in hits.keys() | spans.keys():
            name, item, k, s = self.items[n]
            found = hits.get(n, [])
            places = stretches(found, k, s, len(item)) if len(found) >= s else []
            best = None
            for left, right in joined(places + spans.get(n, [])):
                got = myers(item, text[left:right], k)
                if got and (best is None or got[0] < best[0]):
                    best = got[0], left + got[1]
            if best:
                out.append((name, best[0], len(item), best[1]))
        return sorted(out)


def item_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """Normal items in blocks of about ``block_chars`` characters."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // block_chars)
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()  # about block_chars characters
        block = [(r["item_id"], t) for r in rows if (t := normal(r["text"]))]
        if block:
            yield block


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, item_id, distance, n_chars of the normal item, end in the normal text) of all items found."""
    spark = docs.sparkSession
    given = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = spark.createDataFrame([], MATCHES)
    for block in item_blocks(benchmark):
        shared = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            finder = None
            for batch in batches:
                finder = finder or Finder(shared.value, rate)
                rows = []
                for name, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    rows += [{"doc_id": name, "item_id": i, "distance": d, "n_chars": m, "end": e} for i, d, m, e in finder.find(normal(text))]
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("n_chars", pa.int32()), ("end", pa.int32())]))

        out = out.union(given.mapInArrow(search, MATCHES))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """``docs`` without those that hold a test item."""
    out = docs
    for block in item_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            finder = None
            for batch in batches:
                finder = finder or Finder(shared.value, rate)
                yield batch.filter(pa.array([not finder.find(normal(t)) for t in batch.column("text").to_pylist()], pa.bool_()))

        out = out.mapInArrow(keep, docs.schema)
    return out
