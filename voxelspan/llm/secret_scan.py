"""Secret scans: pattern rules, and a character convolutional network for every other candidate.

Rules find assignments, access keys and hexadecimal runs. The network, in numpy, judges each run of 16 or more key
characters that does not lie wholly inside a rule's finding, and each run of ``SHORTEST`` or more after a word like key
or password, with ``CONTEXT`` characters on either side; long candidates are read whole, in overlapping windows of which
the highest counts. It is trained on labelled findings: windows of a bounded, hash-ordered sample of documents (what an
assignment or access rule finds is a secret; words of the document, joined or put after a word like key, are none; runs
that no rule finds stay unlabelled), and examples made by rule of further kinds of keys and of look-alikes
(``examples``). A quarter of the documents and of the made examples, all of their windows, is held back: Platt scaling calibrates the
scores there, and the threshold is the highest that finds the share ``RECALL`` of the held-back secrets.

Defined results: a null text counts as empty and has no spans; repeated rows are scanned each for itself; an empty
table gives no rows; without sampled documents the network is trained on the made examples alone; further columns
are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The base rules, fixed by the contract: pattern and least length (of group 2 for assign).
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "cnn")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
SHORTEST = 6
#: A shorter run after a key-like word; the lookahead lets a key-like word be a run itself.
SHORT = re.compile(rf"""(?i:pass(?:word|wd|phrase|code)?|pwd|secret|token|key|credentials?|bearer|auth(?:orization)?)(?=["']?(?:\s*(?:=>|[:=]|is\b)\s*|\s+)["']?([A-Za-z0-9+/_=-]{{{SHORTEST},15}})(?![A-Za-z0-9+/_=-]))""", re.ASCII)
#: Neighbouring words of a text that look-alikes are made of.
WORDS = re.compile(r"(?<![^\s])[A-Za-z]+(?: [A-Za-z]+){2,7}(?![^\s.,;])")
CONTEXT, BODY = 24, 64
WIDTH = CONTEXT + BODY + CONTEXT
#: Most documents and windows of the training sample.
SAMPLE_DOCS, SAMPLE_WINDOWS = 2_000, 3_000
RECALL = 0.95
SPANS = "doc_id long, n_assign long, n_access long, n_hex long, n_cnn long, starts array<int>, ends array<int>, kinds array<int>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the rules' findings, leftmost and without overlap within a kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def reach(found: list[tuple[int, int, int]]) -> Callable[[int], int]:
    """Of findings in the order of their start: how far those that start at a place or before reach; -1 if none does."""
    starts, ends = [x for x, _, _ in found], [*accumulate((y for _, _, y in found), max)]

    def to(at: int) -> int:
        k = bisect_right(starts, at)
        return ends[k - 1] if k else -1

    return to


def candidates(text: str, found: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs of key characters, shorter ones only after a key-like word, that do not lie wholly inside a rule's finding."""
    runs, to = {m.span() for m in CANDIDATE.finditer(text)} | {m.span(1) for m in SHORT.finditer(text)}, reach(found)
    return sorted((a, b) for a, b in runs if to(a) < b)


def windows(text: str, a: int, b: int) -> list[str]:
    """The candidate with its context, in windows of at most BODY characters of it."""
    before, after = text[max(0, a - CONTEXT) : a].rjust(CONTEXT, "\0"), text[b : b + CONTEXT].ljust(CONTEXT, "\0")
    return [before + text[k : min(b, k + BODY)].ljust(BODY, "\0") + after for k in range(a, max(a + 1, b - BODY // 2), BODY // 2)]


def codes(texts: list[str]) -> np.ndarray:
    """(n, WIDTH) character classes: ASCII as it is, one class for all else; the third quarter of the table marks the body."""
    x = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").reshape(-1, WIDTH)
    x = np.minimum(x, 128).astype(np.int16)
    x[:, CONTEXT : CONTEXT + BODY] += 129
    return x


class Network:
    """Embedding, convolution, rectifier, maximum and mean over places, logistic output."""

    SPAN, DIM, FILTERS = 5, 8, 24

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.e = r.normal(0, 0.5, (258, self.DIM)).astype(np.float32)
        self.w = r.normal(0, (2 / (self.SPAN * self.DIM)) ** 0.5, (self.SPAN * self.DIM, self.FILTERS)).astype(np.float32)
        self.b = np.zeros(self.FILTERS, np.float32)
        self.v = r.normal(0, 0.1, 2 * self.FILTERS).astype(np.float32)
        self.c = np.zeros(1, np.float32)
        self.scale, self.limit = np.asarray([1.0, 0.0]), 0.5

    def forward(self, x: np.ndarray):
        n, places = len(x), WIDTH - self.SPAN + 1
        held = self.e[x]
        rows = np.lib.stride_tricks.sliding_window_view(held, self.SPAN, axis=1).transpose(0, 1, 3, 2).reshape(n * places, -1)
        h = np.maximum(rows @ self.w + self.b, 0).reshape(n, places, self.FILTERS)
        top = h.argmax(1)
        z = np.concatenate([np.take_along_axis(h, top[:, None], 1)[:, 0], h.mean(1)], 1)
        return z @ self.v + self.c, (rows, h, top, z)

    def raw(self, texts: list[str]) -> np.ndarray:
        return np.concatenate([self.forward(codes(texts[k : k + 256]))[0] for k in range(0, len(texts), 256)]) if texts else np.zeros(0)

    def probability(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * raw + self.scale[1], -30, 30)))

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, rate: float = 0.02) -> None:
        names = ("e", "w", "b", "v", "c")
        first, second = ({k: np.zeros_like(getattr(self, k)) for k in names} for _ in range(2))
        order, step = np.random.default_rng(3), 0
        steps = epochs * max(1, len(x) // 128)
        for _ in range(epochs):
            for at in np.array_split(order.permutation(len(x)), max(1, len(x) // 128)):
                out, (rows, h, top, z) = self.forward(x[at])
                d = ((1 / (1 + np.exp(-np.clip(out, -30, 30))) - y[at]) / len(at)).astype(np.float32)
                dz = d[:, None] * self.v
                dh = np.repeat(dz[:, None, self.FILTERS :] / h.shape[1], h.shape[1], 1)
                np.put_along_axis(dh, top[:, None], np.take_along_axis(dh, top[:, None], 1) + dz[:, None, : self.FILTERS], 1)
                dh = (dh * (h > 0)).reshape(-1, self.FILTERS)
                grad = {"v": z.T @ d, "c": d.sum(keepdims=True), "w": rows.T @ dh, "b": dh.sum(0), "e": np.zeros_like(self.e)}
                dr = (dh @ self.w.T).reshape(len(at), -1, self.SPAN, self.DIM)
                for k in range(self.SPAN):
                    np.add.at(grad["e"], x[at][:, k : k + dr.shape[1]], dr[:, :, k])
                step += 1
                for k in names:
                    first[k] = 0.9 * first[k] + 0.1 * grad[k]
                    second[k] = 0.99 * second[k] + 0.01 * grad[k] ** 2
                    setattr(self, k, (getattr(self, k) - rate * (1 - (step - 1) / steps) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32))

    def calibrate(self, texts: list[str], y: np.ndarray) -> None:
        """Platt scaling by Newton's method, then the highest threshold with the wanted recall."""
        raw = self.raw(texts).astype(np.float64)
        a = np.asarray([1.0, 0.0])
        rows = np.stack([raw, np.ones_like(raw)], 1)
        for _ in range(20):
            p = 1 / (1 + np.exp(-np.clip(rows @ a, -30, 30)))
            h = (rows * (p * (1 - p))[:, None]).T @ rows + 1e-3 * np.eye(2)
            a = a - np.linalg.solve(h, rows.T @ (p - y) + 1e-3 * a)
        self.scale = a
        p = np.sort(self.probability(raw[y == 1]))
        self.limit = float(p[int((1 - RECALL) * len(p))]) if len(p) else 0.5


def examples(n: int = 4_000, seed: int = 11) -> tuple[list[str], list[int], list[int]]:
    """Labelled windows made by rule, and the number of the example that each is from: keys of common shapes, and look-alikes that are none."""
    r = np.random.default_rng(seed)
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    draw = lambda letters, k: "".join(letters[i] for i in r.integers(0, len(letters), k))
    words = lambda k: " ".join(draw(lower, int(r.integers(2, 9))) for _ in range(k))
    spoken = lambda k: "".join("bcdfglmnprstvw"[int(r.integers(14))] + "aeiou"[int(r.integers(5))] for _ in range(k))
    mixed, out, y, origin = upper + lower + digits, [], [], []
    for k in range(n):
        secret = k % 2
        if secret:
            body = [
                    lambda: "ghp_" + draw(mixed, 36), lambda: "xoxb-" + draw(digits, 11) + "-" + draw(mixed, 24), lambda: "sk-" + draw(mixed, 40), lambda: "eyJ" + draw(mixed + "_-", 48), lambda: draw(mixed + "+/", 40) + "=", lambda: draw(upper + digits, 32), lambda: draw(mixed, int(r.integers(20, 64))),
                    lambda: "xoxb-" + draw(digits, 16) + "-" + draw(mixed, 24), lambda: draw(upper + lower, int(r.integers(16, 48))), lambda: draw(upper, int(r.integers(16, 40))), lambda: draw(mixed, int(r.integers(8, 16))), lambda: draw(lower + digits, int(r.integers(SHORTEST, 16))), lambda: spoken(2) + draw(digits, int(r.integers(2, 5))) + draw(mixed, int(r.integers(2, 6)))][int(r.integers(13))]()
            lead = ["key ", "Authorization: Bearer ", "export KEY=", "credential: ", "use "][int(r.integers(5))] if len(body) >= 16 else ["key ", "Bearer ", "KEY=", "credential: ", "password is ", "pwd: ", "secret = '", "token: "][int(r.integers(8))]
        else:
            body = [
                    lambda: draw(lower, 7) + "-" + draw(lower, 6) + "-" + draw(digits, 4), lambda: "/".join(draw(lower, 6) for _ in range(4)) + "/" + draw(digits, 4), lambda: f"20{draw(digits, 2)}-0{draw(digits[1:], 1)}-1{draw(digits, 1)}T{draw(digits, 2)}-00-00", lambda: "_".join(draw(lower, 5) for _ in range(3)) + draw(digits, 1), lambda: "=" * 20 + draw(digits, 1), lambda: draw(digits, 3) + "-" + draw(digits, 3) + "-" + draw(digits, 4) + "-" + draw(digits, 5), lambda: draw(lower, 20) + draw(digits, 1),
                    lambda: "-=_/+"[int(r.integers(5))] * int(r.integers(16, 60)), lambda: spoken(int(r.integers(8, 14))), lambda: "-_/"[int(r.integers(3))].join(spoken(int(r.integers(2, 5))) for _ in range(4)), lambda: "".join(spoken(3).title() for _ in range(4)), lambda: spoken(3).ljust(SHORTEST, "s")][int(r.integers(12))]()
            lead = ["see ", "at ", "file ", "on ", "the "][int(r.integers(5))] if len(body) >= 16 else ["the key ", "a token ", "secret ", "password is ", "key: "][int(r.integers(5))]
        text = f"{words(5)} {lead}{body} {words(5)}"
        a = text.index(body)
        got = windows(text, a, a + len(body))
        out += got
        y += [secret] * len(got)
        origin += [k // 2] * len(got)
    return out, y, origin


def look_alike(text: str, found: list[tuple[int, int, int]]) -> list[str]:
    """Windows of a run that is no secret, made in the text of its own words: some joined, or one after a key-like word."""
    n, to = len(text), reach(found)
    for m in WORDS.finditer(text, n // 3):
        if to(m.end() - 1) > m.start():
            continue
        words, long = m[0].split(" "), n % 3 < 2
        before, after = text[: m.start()], text[m.end() :]
        if long:
            body = ("", "", "-", "_", "/")[n % 5].join(words)[:60]
        else:
            body = max(words, key=len)
            before += ("key ", "the token ", "password is ", "secret ", "key: ")[n % 5]
        if len(body) < (16 if long else SHORTEST):
            continue
        return windows(before + body + after, len(before), len(before) + len(body))
    return []


def labelled_windows(docs: DataFrame) -> tuple[list[str], list[int], list[int]]:
    """At most SAMPLE_WINDOWS windows of a hash-ordered sample of SAMPLE_DOCS documents, and a hash of the text each is from: the rules' findings, and look-alikes."""
    names = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    sample = docs.join(F.broadcast(names), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), F.pmod(F.xxhash64("text"), F.lit(1 << 20)).cast("int").alias("origin"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, origin in zip(batch.column("text").to_pylist(), batch.column("origin").to_pylist(), strict=True):
                found = base_spans(text)
                rows += [{"window": w, "secret": 1, "origin": origin} for a, kind, b in found if kind < 2 for w in windows(text, a, b)]
                rows += [{"window": w, "secret": 0, "origin": origin} for w in look_alike(text, found)]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("window", pa.string()), ("secret", pa.int32()), ("origin", pa.int32())]))

    rows = sample.mapInArrow(cut, "window string, secret int, origin int").orderBy(F.xxhash64("window"), "window").limit(SAMPLE_WINDOWS).collect()
    return [r["window"] for r in rows], [r["secret"] for r in rows], [r["origin"] for r in rows]


def fit(docs: DataFrame) -> Network:
    texts, y, origin = (a + b for a, b in zip(examples(), labelled_windows(docs.select("doc_id", "text")), strict=True))
    y, held = np.asarray(y, np.float64), np.asarray(origin) % 4 == 0
    net = Network()
    net.train(codes([t for t, h in zip(texts, held, strict=True) if not h]), y[~held])
    net.calibrate([t for t, h in zip(texts, held, strict=True) if h], y[held])
    return net


def find(texts: list[str], net: Network) -> list[list[tuple[int, int, int]]]:
    """All spans (start, kind, end) of each text, by start, then kind."""
    spans = [base_spans(t) for t in texts]
    asked = [(k, a, b) for k, t in enumerate(texts) for a, b in candidates(t, spans[k])]
    for at in range(0, len(asked), 4_000):
        part = asked[at : at + 4_000]
        own = [windows(texts[k], a, b) for k, a, b in part]
        raw = net.raw([w for ws in own for w in ws])
        first = np.cumsum([0, *map(len, own[:-1])])
        best = net.probability(np.maximum.reduceat(raw, first))
        for (k, a, b), p in zip(part, best, strict=True):
            last = spans[k][-1] if spans[k] else (0, 0, 0)
            if p >= net.limit and not (last[1] == 3 and b <= last[2]):
                spans[k].append((a, 3, b))
    return [sorted(s) for s in spans]


def scan(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """Per document the spans of all findings (``SPANS``): code points, end exclusive, kinds as indexes of KINDS."""
    net = net or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            found = []
            for k in range(0, len(texts), 500):
                found += find(texts[k : k + 500], shared.value)
            count = lambda kind: pa.array([sum(x[1] == kind for x in s) for s in found], pa.int64())
            lists = [pa.array([[x[i] for x in s] for s in found], pa.list_(pa.int32())) for i in (0, 2, 1)]
            yield pa.RecordBatch.from_arrays([names, *map(count, range(4)), *lists], [c.split()[0] for c in SPANS.split(", ")])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return given.mapInArrow(run, SPANS)


def redact(docs: DataFrame, net: Network | None = None, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every finding in ``text`` replaced by ``mark``; ``n_chars``, where there, is counted anew."""
    net = net or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def clean(text: str, spans: list[tuple[int, int, int]]) -> str:
        out, at = [], 0
        for a, _, b in spans:
            if a >= at:
                out += [text[at:a], mark]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            out = []
            for k in range(0, len(texts), 500):
                part = [t or "" for t in texts[k : k + 500]]
                out += [t and clean(t, s) for t, s in zip(texts[k : k + 500], find(part, shared.value), strict=True)]
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(out, pa.string()))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
