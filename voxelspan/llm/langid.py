"""Language identification of mixed text: script ranges, per-word scores, Viterbi with a switching penalty.

A word is a run of letters. The script of its first letter narrows the languages to those that use it in the
training texts. Its score in a language is the sum of smoothed log shares of its character 1- to 4-grams (with
word bounds), hashed into ``BUCKETS``; differences are clipped at ``CLIP``. The path through the words of a text
that maximises scores less ``PENALTY`` per change of language gives its spans; the language with the most letters
is the text's (ties: first by name), its share of the letters the score.

A text whose best single language can lose no stretch of words by more than the penalty is labelled without the
search: no change pays for itself, so the path is the same.

Training uses at most ``TRAIN_DOCS`` texts with a language, in the order of a hash. Defined results: text that is
null or has no letters gives ``und`` with score 0 and no spans, as does an empty training set; repeated rows are
labelled each for itself; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import Numbers

BUCKETS = 1 << 15
TRAIN_DOCS = 12_000
ORDERS = (1, 2, 3, 4)
PENALTY, CLIP = 12.0, 6.0
WORD = re.compile(r"[^\W\d_]+")
#: A worker keeps the scores of so many words before it starts anew.
SEEN_WORDS = 500_000
#: First code point and name of script ranges; what lies before the next entry belongs to it. Fixed values.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "indic"), (0x0E00, "thai"), (0x0E80, "other"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB50, "arabic"), (0xFE00, "other"), (0x20000, "han"),
)
_STARTS = [a for a, _ in SCRIPTS]
NAMES = sorted({n for _, n in SCRIPTS})
OUT = "doc_id long, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>"


def script(char: str) -> int:
    return NAMES.index(SCRIPTS[bisect_right(_STARTS, ord(char)) - 1][1])


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the words, and the word that each belongs to."""
    joined = "".join(f"\1{w}\2" for w in words)
    x = np.frombuffer(joined.encode("utf-32-le"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    out, own = [], []
    h = np.zeros(len(x), np.uint64)
    for n in ORDERS:
        h = h[: len(x) - n + 1] * np.uint64(0x100000001B3) + x[n - 1 :] + np.uint64(n)
        inside = owner[: len(h)] == owner[n - 1 :]
        mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append((mixed[inside] >> np.uint64(40)).astype(np.int64) % BUCKETS)
        own.append(owner[: len(h)][inside])
    return np.concatenate(out), np.concatenate(own)


def letters_of(run: str) -> list[tuple[int, str]]:
    """The words of a run that also holds numbers other than digits (fractions, circled ones), with their places."""
    shown = "".join(c if c.isalpha() else " " for c in run)
    return [(m.start(), m.group()) for m in re.finditer(r"\S+", shown)]


def words_of(text: str) -> list[str]:
    runs = WORD.findall(text)
    return runs if all(map(str.isalpha, runs)) else [w for run in runs for _, w in letters_of(run)]


def starts_of(text: str) -> list[int]:
    return [m.start() + at for m in WORD.finditer(text) for at in ((0,) if m.group().isalpha() else [a for a, _ in letters_of(m.group())])]


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray, letters: np.ndarray):
        """counts: (BUCKETS, languages) of n-grams; letters: (scripts, languages) of words."""
        self.langs = langs
        shares = (counts + 0.5) / (counts.sum(0) + 0.5 * BUCKETS)
        self.logs = np.log(shares).astype(np.float32)
        self.allowed = letters >= 0.001 * np.maximum(letters.sum(0), 1)
        self.seen, self.scores = Numbers(), np.zeros((0, len(langs)))

    def scores_of(self, words: Iterator[str], n: int) -> np.ndarray:
        """``word_scores`` of n words in any case; those of words met before are kept."""
        if len(self.seen) > SEEN_WORDS:
            self.seen, self.scores = Numbers(), self.scores[:0]
        code = np.fromiter(map(self.seen.__getitem__, words), np.int64, n)
        new = [w.lower() for w in self.seen.new]
        self.seen.new.clear()
        self.scores = np.concatenate([self.scores, *(self.word_scores(new[k : k + 50_000]) for k in range(0, len(new), 50_000))])
        return self.scores[code]

    def word_scores(self, words: list[str]) -> np.ndarray:
        """(words, languages): 0 for the best language of a word, less for others, CLIP below at most."""
        which, own = grams(words)
        s = np.zeros((len(words), len(self.langs)), np.float64)
        for k in range(len(self.langs)):
            s[:, k] = np.bincount(own, weights=self.logs[which, k], minlength=len(words))
        open_to = self.allowed[[script(w[0]) for w in words]]
        none = ~open_to.any(1)
        s[none] = 0
        s[~open_to & ~none[:, None]] = -np.inf
        s -= s.max(1, keepdims=True)
        return np.maximum(s, -CLIP)


def viterbi(s: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Best path through (words, languages) scores. At equal values staying wins, then the first language."""
    n, k = s.shape
    came = np.tile(np.arange(k, dtype=np.int32), (n, 1))
    v = s[0].tolist()
    for a in range(1, n, 4_096):
        for t, row in enumerate(s[a : a + 4_096].tolist(), a):  # few languages: lists take half the time of arrays
            top = max(v)
            low = top - penalty
            if low > min(v):
                b = v.index(top)
                came[t] = [b if low > x else c for c, x in enumerate(v)]
                v = [(low if low > x else x) + y for x, y in zip(v, row, strict=True)]
            else:
                v = [x + y for x, y in zip(v, row, strict=True)]
    path = np.empty(n, np.int32)
    path[-1] = v.index(max(v))
    for t in range(n - 1, 0, -1):
        path[t - 1] = came[t][path[t]]
    return path


def paths(s: np.ndarray, sizes: np.ndarray) -> list[np.ndarray | int]:
    """For texts of so many words each, one after the other in ``s``: the path, or one language for all words."""
    ends = np.cumsum(sizes)
    firsts = ends - sizes
    best = np.add.reduceat(s, firsts, axis=0).argmax(1)
    loss = s.max(1) - s[np.arange(len(s)), np.repeat(best, sizes)]  # what other languages gain at each word
    out: list[np.ndarray | int] = []
    for a, b, k in zip(firsts.tolist(), ends.tolist(), best.tolist(), strict=True):
        run = np.cumsum(loss[a:b])
        # losses are never negative, so the whole text is the stretch that loses most
        if run[-1] <= PENALTY:
            out.append(k)
            continue
        d = s[a:b].copy()
        d[:, k] = -np.inf
        gain = np.cumsum(d.max(1) - s[a:b, k])  # the best that any other languages can gain on a stretch
        if (gain - np.minimum.accumulate(np.concatenate([[0.0], gain[:-1]]))).max() <= PENALTY:
            out.append(k)
        else:
            out.append(viterbi(s[a:b]))
    return out


def label(texts: list[str], model: Model) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """(language, score, spans) of each text."""
    found = [words_of(t) for t in texts]
    n = sum(map(len, found))
    if not n or not model.langs:
        return [("und", 0.0, [])] * len(texts)
    s = model.scores_of(chain.from_iterable(found), n)
    sizes = np.asarray([len(x) for x in found])
    got = iter(paths(s, sizes[sizes > 0]))
    out = []
    for text, own in zip(texts, found, strict=True):
        if not own:
            out.append(("und", 0.0, []))
            continue
        path = next(got)
        if isinstance(path, int):
            out.append((model.langs[path], 1.0, [(0, len(text), model.langs[path])]))
            continue
        sizes_ = np.asarray([len(w) for w in own])
        letters = np.bincount(path, weights=sizes_, minlength=len(model.langs))
        k = int(letters.argmax())
        turns = np.flatnonzero(np.diff(path)) + 1
        starts = starts_of(text)
        cuts = [0, *(starts[t] for t in turns.tolist()), len(text)]
        spans = [(a, b, model.langs[path[t]]) for a, b, t in zip(cuts[:-1], cuts[1:], [0, *turns.tolist()], strict=True)]
        out.append((model.langs[k], float(letters[k] / letters.sum()), spans))
    return out


def fit(train: DataFrame, most: int = TRAIN_DOCS) -> Model:
    """A model of ``train(text, lang)`` from at most ``most`` of its texts, each once; rows without a language are ignored."""
    known = train.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("text").alias("h"))
    names = known.select("lang", "h").distinct().orderBy("h", "lang").limit(most)
    chosen = known.join(F.broadcast(names), ["lang", "h"]).dropDuplicates(["lang", "h"]).select("lang", "text")  # bounded by `most`

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = words_of(text.lower())
                if not words:
                    continue
                held = counts.setdefault(lang, np.zeros(BUCKETS + len(NAMES), np.int64))
                for k in range(0, len(words), 100_000):
                    part = words[k : k + 100_000]
                    held[:BUCKETS] += np.bincount(grams(part)[0], minlength=BUCKETS)
                    held[BUCKETS:] += np.bincount([script(w[0]) for w in part], minlength=len(NAMES))
        for lang, held in counts.items():
            seen = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen)), pa.array(seen), pa.array(held[seen])], ["lang", "bucket", "n"])

    sums = chosen.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # a row per language and bucket
    langs = sorted(sums["lang"].unique())
    counts = np.zeros((BUCKETS + len(NAMES), len(langs)), np.int64)
    counts[sums["bucket"], [langs.index(x) for x in sums["lang"]]] = sums["n"]
    return Model(langs, counts[:BUCKETS], counts[BUCKETS:])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Language, score and spans (``OUT``) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= 2_000_000):
                    size += len(texts[to])
                    to += 1
                got = label(texts[at:to], shared.value)
                rows = [{"doc_id": d, "lang_pred": g[0], "score": g[1], "spans": [dict(zip(("start", "end", "lang"), x, strict=True)) for x in g[2]]} for d, g in zip(names[at:to], got, strict=True)]
                yield pa.RecordBatch.from_pylist(rows, KIND)
                at = to

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, OUT)


KIND = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))])


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1
