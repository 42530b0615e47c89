"""Best-fit packing of token sequences by bin-completion branch-and-bound over the table of lengths.

Documents are tokenised and those longer than ``capacity`` cut; the pieces then differ, for packing, only in
their length. So the search runs on the counts of at most ``capacity`` lengths, whatever the corpus holds:

* Incumbents: best-fit decreasing, best fit with a subset-sum search for the least waste of each sequence, and tiers of
  equally many pieces (``balanced``). If one of them meets the lower bound (``low_bound``), it is optimal.
* Otherwise ``complete`` branches: the largest length left opens a sequence, and the undominated fillings of its room
  come in order of their waste. A filling is dominated if a left piece still fits, or can take the place of one or two of
  its pieces. A branch is pruned when its waste exceeds what one sequence less than the incumbent could leave empty.
  Each filling is tried as often as the counts allow, and once.

The search ends when every branch is closed (the plan is optimal), or after ``nodes`` steps with the best plan so far;
``nodes=None`` sets no limit. Every row tells the lower bound (``bound``), so a plan that may not be the best shows: it has
more sequences than that.

Spark numbers the pieces of each length without gathering them: ``local`` counts within a task, ``ahead`` sums the
tasks before. A piece's number picks the run (filling, repetition, slot) that holds it.

Defined results: null text counts as empty (only the end id); equal rows are packed each for itself; rows with a
null ``doc_id`` are packed too; an empty table gives no rows; further columns are ignored. Strings of special tokens
in a text get the ids that the library's plain call gives them (``tokens``).
"""

from __future__ import annotations

import heapq
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored
from .tokens import encoder

CAPACITY = 4096
#: Steps of the branch-and-bound (None: until all branches are closed), and of the subset-sum search for one sequence of an incumbent.
NODES, STEPS = 100_000, 2_000
#: Levels of the search that keep their table of reachable sums.
KEPT_SUMS = 32
#: Pieces that ``balanced`` deals out at once; of more, every so many of a length stand for one.
DEALT = 20_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, task long, local long"


Plan = list[tuple[list[tuple[int, int]], int]]  # fillings as (length, times within), and how often each is used


def best_fit(room: int, left: list[int], top: int) -> list[tuple[int, int]]:
    """Fill ``room`` with the longest length of at most ``top`` that fits, again and again."""
    out = []
    k = min(room, top)
    while room > 0:
        k = min(room, k)
        while k > 0 and not left[k]:
            k -= 1
        if k == 0:
            break
        out.append((k, n := min(left[k], room // k)))
        room -= n * k
        k -= 1
    return out


def least_waste(room: int, left: list[int], top: int, steps: int = STEPS) -> list[tuple[int, int]]:
    """The filling of ``room`` with the least waste that ``steps`` steps find; best fit or better."""
    best = best_fit(room, left, top)
    waste = room - sum(x * n for x, n in best)
    if not waste:
        return best
    sums = Sums(room, left, top)
    for spare in range(waste):
        for found in sums.fillings(room - spare):
            return found
        if sums.steps > steps:
            break
    return best


class Sums:
    """Fillings from the counts ``left`` of lengths up to ``top``, by the sums that the lengths up to each can reach.

    kept: of all that share it, the last ``KEPT_SUMS`` to make their table keep it; the others make it anew when they go on, with the same counts left.
    """

    def __init__(self, room: int, left: list[int], top: int, kept: deque[Sums] | None = None):
        self.left, self.top, self.room, self.steps, self.reach, self.kept = left, min(room, top), room, 0, None, kept

    def table(self) -> tuple[list[int], list[int]]:
        """The lengths in ascending order, and for each k the sums of the first k as bits."""
        if self.reach is None:
            full, sums, lengths = (1 << (self.room + 1)) - 1, [1], []
            for x in range(1, self.top + 1):
                n = min(self.left[x], self.room // x)
                if n:
                    bits, part = sums[-1], 1
                    while n:
                        part = min(part, n)
                        bits |= bits << part * x & full
                        n -= part
                        part *= 2
                    sums.append(bits)
                    lengths.append(x)
            self.reach = lengths, sums
            if self.kept is not None:
                self.kept.append(self)
                if len(self.kept) > KEPT_SUMS:
                    self.kept.popleft().reach = None
        return self.reach

    def fillings(self, target: int, below: int | None = None) -> Iterator[list[tuple[int, int]]]:
        """All fillings that sum to ``target``, long pieces first; below: how many of the lengths may be used."""
        if target == 0:
            yield []
            return
        # no table in a variable: the open levels of a search would hold all of theirs
        k = len(self.table()[0]) if below is None else below
        while k and self.table()[1][k] >> target & 1:
            x = self.table()[0][k - 1]
            for n in range(min(self.left[x], target // x), 0, -1):
                self.steps += 1
                if self.table()[1][k - 1] >> (target - n * x) & 1:
                    for rest in self.fillings(target - n * x, k - 1):
                        yield [(x, n), *rest]
            k -= 1


def dominated(filling: list[tuple[int, int]], spare: int, left: list[int], top: int) -> bool:
    """Whether a left piece fits into the spare room, alone or in the place of one or two pieces of the filling."""
    used = dict(filling)
    free = lambda a, b: any(left[x] > used.get(x, 0) for x in range(max(a, 1), min(b, top) + 1))
    if spare and (free(1, spare) or any(free(x + 1, x + spare) for x, _ in filling)):
        return True
    return any(free(x + y, x + y + spare) for i, (x, n) in enumerate(filling) for y, _ in filling[i if n > 1 else i + 1 :])


def crowd_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences needed by the pieces of which at most q go together, for the q that asks for most; and by rounding lengths to k-ths of a sequence."""
    size = np.arange(capacity + 1)
    n, total = np.cumsum(counts), np.cumsum(counts * size)
    pieces = int(n[-1])

    def smallest(m: int) -> int:
        """Total length of the m smallest pieces."""
        x = int(np.searchsorted(n, m))
        return int(total[x]) - (int(n[x]) - m) * x

    best = 0
    for q in range(1, min(capacity, pieces - 1) + 1):
        if smallest(q + 1) > capacity:
            return max(best, -(-pieces // q))
        a, b = 0, pieces - q - 1  # the first place from which q + 1 neighbours do not fit; b: the last place there is
        if smallest(b + q + 1) - smallest(b) > capacity:
            while a < b:
                m = (a + b) // 2
                a, b = (a, m) if smallest(m + q + 1) - smallest(m) > capacity else (m + 1, b)
            best = max(best, -(-(pieces - a) // q))
    for k in range(1, 100):
        whole = (k + 1) * size % capacity == 0
        share = np.where(whole, k * size, (k + 1) * size // capacity * capacity)  # in parts of k * capacity
        best = max(best, -(-sum(int(c) * int(x) for c, x in zip(counts, share, strict=True) if c) // (k * capacity)))
    return best


def low_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that any plan needs: by total length, by Martello and Toth's bound for each least length k, and by ``crowd_bound``."""
    size = np.arange(capacity + 1)
    n, total = np.cumsum(counts), np.cumsum(counts * size)
    best = max(-(-int(total[-1]) // capacity), crowd_bound(counts, capacity))
    half = capacity // 2
    for k in range(1, half + 1):
        large, middle = int(n[capacity] - n[half]), int(n[capacity - k] - n[half])
        room = middle * capacity - int(total[capacity - k] - total[half])
        best = max(best, large + max(0, -(-(int(total[half] - total[k - 1]) - room) // capacity)))
    return best


def dive(left: list[int], capacity: int, fill) -> Plan:
    """A plan that fills each sequence in turn around the largest length left."""
    left, out, top = list(left), [], capacity
    while True:
        while top and not left[top]:
            top -= 1
        if not top:
            return out
        left[top] -= 1
        filling = [(top, 1)]
        for x, n in fill(capacity - top, left, top):
            filling = [(x, n + 1)] if x == top else [*filling, (x, n)]
        left[top] += 1
        times = min(left[x] // n for x, n in filling)
        for x, n in filling:
            left[x] -= n * times
        out.append((filling, times))


def dealt(pieces: list[int], q: int, capacity: int) -> list[list[int]] | None:
    """``pieces``, in ascending order, dealt out by q: the longest left goes to the emptiest sequence; None if one overflows."""
    bins: list[list[int]] = [[] for _ in range(-(-len(pieces) // q))]
    heap = [(0, k) for k in range(len(bins))]
    for x in reversed(pieces):
        full, k = heapq.heappop(heap)
        if full + x > capacity:
            return None
        bins[k].append(x)
        if len(bins[k]) < q:
            heapq.heappush(heap, (full + x, k))
    return bins


def tiers(pieces: list[int], capacity: int) -> list[list[int]]:
    """Sequences of equally many pieces: as few of the longest as can be by 1, of those left as few by 2, and so on."""
    out: list[list[int]] = []
    q = 1
    while len(pieces) > q:
        a, b, found = 0, -(-len(pieces) // q), None
        while a < b:  # fewest sequences of q, if those left can be dealt out by q + 1
            m = (a + b) // 2
            at = len(pieces) - m * q
            long = dealt(pieces[at:], q, capacity)
            short = dealt(pieces[:at], q + 1, capacity) if long is not None else None
            if short is None:
                a = m + 1
            else:
                b, found = m, (at, long, short)
        if found is None:
            return [*out, *dealt(pieces, q, capacity)]  # as was tried before
        at, long, short = found
        out += long
        pieces = pieces[:at]
        q += 1
    return [*out, pieces] if pieces else out


def balanced(left: list[int], capacity: int) -> Plan:
    """A plan of ``tiers``; of many pieces, every 2^k of a length are dealt out as one, what is over in halves of that, and so on."""
    left, out = list(left), []
    scale = 1
    while sum(n // scale for n in left) > DEALT:
        scale *= 2
    while scale:
        for held in tiers([x for x, n in enumerate(left) for _ in range(n // scale)], capacity):
            times = {x: held.count(x) for x in set(held)}
            out.append((sorted(times.items(), reverse=True), scale))
        left = [n % scale for n in left]
        scale //= 2
    return out


def complete(left: list[int], capacity: int, best: Plan, low: int, nodes: int | None) -> Plan:
    """Bin completion: a plan with fewer sequences than ``best``, down to ``low``, if there is one and the steps suffice."""
    left, total = list(left), sum(x * n for x, n in enumerate(left))
    most = sum(t for _, t in best)
    path: Plan = []
    kept: deque[Sums] = deque()
    bins = wasted = steps = 0

    def children(top: int) -> Iterator[tuple[list[tuple[int, int]], int, int]]:
        """(filling, times, spare) of the undominated fillings around a piece of length ``top``."""
        nonlocal steps
        room = capacity - top
        left[top] -= 1
        sums = Sums(room, left, top, kept)
        sums.table()
        left[top] += 1
        for spare in range(room + 1):
            if wasted + spare > (most - 1) * capacity - total:
                return
            own = sums.fillings(room - spare)
            while True:
                left[top] -= 1
                before = sums.steps
                rest = next(own, None)
                bad = rest is not None and dominated(rest, spare, left, top)
                left[top] += 1
                steps += sums.steps - before + 1
                if nodes is not None and steps > nodes or rest is None:
                    break
                if bad:
                    continue
                filling = [(top, rest[0][1] + 1), *rest[1:]] if rest and rest[0][0] == top else [(top, 1), *rest]
                times = min(left[x] // n for x, n in filling)
                yield filling, times, spare
                if times > 1:
                    yield filling, 1, spare
            if nodes is not None and steps > nodes:
                return

    def largest() -> int:
        top = path[-1][0][0][0] if path else capacity
        while top and not left[top]:
            top -= 1
        return top

    levels = [children(largest())]
    spares: list[int] = []
    while levels:
        got = next(levels[-1], None)
        if got is None:
            levels.pop()
            if path:
                filling, times = path.pop()
                bins, wasted = bins - times, wasted - times * spares.pop()
                for x, n in filling:
                    left[x] += n * times
            continue
        filling, times, spare = got
        if wasted + times * spare > (most - 1) * capacity - total:
            continue
        path.append((filling, times))
        spares.append(spare)
        bins, wasted = bins + times, wasted + times * spare
        for x, n in filling:
            left[x] -= n * times
        top = largest()
        if top:
            levels.append(children(top))
            continue
        best, most = list(path), bins
        if most <= low:
            break
        levels.append(iter(()))
    return best


def plan(counts: dict[int, int], capacity: int = CAPACITY, nodes: int | None = NODES) -> tuple[np.ndarray, int, int]:
    """Runs (length, first number, last number + 1, first sequence, offset) for all pieces, the number of sequences, and its lower bound."""
    left = [0] * (capacity + 1)
    for length, n in counts.items():
        left[length] += n
    low = low_bound(np.asarray(left), capacity)
    used = lambda p: sum(t for _, t in p)
    best = min((dive(left, capacity, fill) for fill in (best_fit, least_waste)), key=used)
    if used(best) > low:
        best = min(best, balanced(left, capacity), key=used)
    if used(best) > low:
        best = complete(left, capacity, best, low, nodes)
    taken, runs, bins = [0] * (capacity + 1), [], 0
    for filling, times in best:
        offset = 0
        for x, n in filling:
            for _ in range(n):
                runs.append((x, taken[x], taken[x] + times, bins, offset))
                taken[x] += times
                offset += x
        bins += times
    return np.asarray(runs, np.int64).reshape(-1, 5), bins, low


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of ``docs(doc_id, text)`` with a number among the pieces of equal length within the task."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        end, coder = np.asarray([end_id], "<u4").tobytes(), encoder(tokenizer, False)
        for batch in batches:
            names, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for k in range(0, len(texts), 1000):
                out: list[list] = [[] for _ in range(8)]
                for name, ids in zip(names[k : k + 1000], coder.encode(texts[k : k + 1000]), strict=True):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        length = len(own) // 4
                        row = (name, piece, at // 4, length, zlib.crc32(own), own if with_ids else None, task, int(seen[length]))
                        seen[length] += 1
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], [c.split()[0] for c in PIECES.split(", ")])

    return rows.mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset``; sequences have no gaps. ``bound``: sequences that any plan needs."""
    spark = docs.sparkSession
    cut = stored(pieces(docs, tokenizer, end_id, capacity, with_ids), "pieces")
    by_task = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    by_task = stored(by_task.select("task", "length", "n", F.coalesce(ahead, F.lit(0)).alias("ahead")), "lengths")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    runs, _, low = plan(counts, capacity)
    order = np.lexsort((runs[:, 1], runs[:, 0]))
    shared = spark.sparkContext.broadcast(runs[order])
    width = int(runs[:, 2].max()) + 1 if len(runs) else 1

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        keys = runs[:, 0] * width + runs[:, 1] if len(runs) else np.zeros(0, np.int64)
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("_number").to_numpy()
            run = runs[np.searchsorted(keys, length * width + number, "right") - 1]
            columns = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(run[:, 3] + number - run[:, 1]), pa.array(run[:, 4])], [*kept, "sequence_id", "offset"])

    kept = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    ahead_of = by_task.select("task", "length", "ahead").hint("merge")  # a row per task and length: too many to broadcast
    numbered = cut.join(ahead_of, ["task", "length"]).select(*kept, (F.col("local") + F.col("ahead")).alias("_number"))
    placed = numbered.mapInArrow(place, ", ".join(c for c in PIECES.split(", ") if c.split()[0] in kept) + ", sequence_id long, offset long")
    return placed.withColumn("bound", F.lit(low).cast("long"))
