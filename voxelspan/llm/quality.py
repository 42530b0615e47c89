"""Quality rules: counted base rules, then the hashed n-gram log-likelihood ratio of two multinomials.

Every text is a bag of two n-grams per word, hashed into buckets: the word itself, and the last two characters
of the word together with those of the next one (how words end tells prose from symbol runs, shouting and
table rows). The number of buckets grows with the corpus as vocabularies do, with the square root of its length
(``n_buckets``). The raw multinomial counts all documents, the trusted one the labelled documents of good quality;
weights are the logarithm of the ratio of their smoothed shares in whole micro-nats, so sums are exact and equal
on every run. A document's score is the mean weight of its n-grams; it is kept if it passes the base rules and
its score is at least the threshold, which is set from labelled documents (``threshold``). One labelled document in
``HELD``, by a hash of its id, takes no part in the trusted multinomial and sets the threshold; where none of these is
good, all labelled documents do both.

DataFrame functions only. To the driver come the weights, one number per bucket and at most ``MOST``, and two order statistics of the labelled scores. All labelled documents take part.

Defined results: a null or blank text has no words and so fails the base rules; null labels are ignored, a
document labelled twice takes its better label; without trusted documents every document that passes the base
rules is kept; repeated rows are judged each for itself; an empty table gives no rows; columns other than doc_id
and text pass through ``judge`` unless they have the name of one of its results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.order import order_statistics
from .shared import stored

WHITE = r"[\x20\x09-\x0D]+"
#: Fewest and most buckets; the weights are a constant of the plan, 8 MB at most.
BUCKETS, MOST = 1 << 14, 1 << 20
#: Most labelled documents whose marks are broadcast; more are joined by a shuffle.
BROADCAST = 100_000
#: Share of trusted documents that the threshold may lose.
LOST = 0.001
HELD = 4
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often and however deep it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE), "")


def repeat_words(words: Column) -> Column:
    """Words that lie in a window of three words found twice or more in the text.

    Most texts end at the first question, whether any hash of a window comes twice. Else windows are sorted as long integers that hold a hash above and their place below; equal hashes then are neighbours, whose words are compared.
    """

    def windows(words: Column) -> Column:
        hashes = F.slice(F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))), F.lit(1), F.size(words) - 2)
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(packed(words, h)))

    def packed(words: Column, hashes: Column) -> Column:
        bits = F.length(F.bin(F.size(words)))
        return let(F.sort_array(F.transform(hashes, lambda h, i: F.call_function("shiftleft", h, bits).bitwiseOR(i.cast("long")))), lambda held: count(words, held, bits))

    def count(words: Column, held: Column, bits: Column) -> Column:
        place = lambda k: F.get(held, k).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1).cast("int")
        key = lambda k: F.call_function("shiftright", F.get(held, k), bits)
        same = lambda a, b: (key(a) == key(b)) & (F.get(words, place(a)) == F.get(words, place(b))) & (F.get(words, place(a) + 1) == F.get(words, place(b) + 1)) & (F.get(words, place(a) + 2) == F.get(words, place(b) + 2))
        m = F.size(held)
        found = F.filter(F.sequence(F.lit(0), m - 1), lambda k: ((k > 0) & same(k, k - 1)) | ((k < m - 1) & same(k, k + 1)))
        covered = lambda at: F.aggregate(at, F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")), lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")))["n"]
        return F.when(F.size(found) == 0, F.lit(0).cast("long")).otherwise(let(F.sort_array(F.transform(found, place)), covered))

    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(windows(words))


def fails(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def accepted(text: Column, score, limit: int) -> Column:
    """Whether a text passes the base rules and its ``score`` is at least ``limit``: one expression, so that a filter evaluates it once."""
    counted = lambda w: F.struct(F.size(w).alias("n"), repeat_words(w).alias("repeat"), F.coalesce(score(w), F.lit(0)).alias("score"))
    return let(words_of(text), lambda w: let(counted(w), lambda c: ~fails(c["n"], c["repeat"]) & (c["score"] >= F.lit(limit))))


def base_counts(docs: DataFrame, score=None) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed, and ``score`` of the words if that is given."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeat_words(w).alias("n_repeat_words"), *([score(w).alias("score")] if score else [])))
    n_dup = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    out = docs.drop(*RESULTS).withColumn("_w", counted).withColumn("n_dup_lines", n_dup)
    out = out.withColumn("n_symbols", F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long")).withColumns({c: F.col(f"_w.{c}") for c in ("n_words", "word_chars", "n_repeat_words", *(["score"] if score else []))}).drop("_w")
    return out.withColumn("base_failed", fails(F.col("n_words"), F.col("n_repeat_words")))


def n_buckets(docs: DataFrame) -> int:
    """Four times the square root of the characters of all texts, as the next power of two within ``BUCKETS`` and ``MOST``."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    return min(max(1 << int(4 * chars**0.5).bit_length(), BUCKETS), MOST)


def grams(words: Column, buckets: int) -> Column:
    """Buckets of the words, then of the ends of the words together with those of the next ones (the last one: with an empty one)."""
    bucket = lambda *x: F.pmod(F.xxhash64(*x), F.lit(buckets)).cast("int")
    end = lambda x: F.right(x, F.lit(2))
    return F.concat(F.transform(words, lambda x: bucket(x)), F.transform(words, lambda x, i: bucket(end(x), end(F.coalesce(F.get(words, i + 1), F.lit(""))))))


def labelled(labels: DataFrame) -> DataFrame:
    """Every document with a quality label, and whether it is held back (null: none of the good ones would be)."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).withColumn("held", F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(HELD)) == 0)
    enough = known.agg(F.max((F.col("held") & (F.col("quality") == 1)).cast("int")).alias("_enough"))  # one row
    return known.crossJoin(F.broadcast(enough)).withColumn("held", F.when(F.col("_enough") == 1, F.col("held"))).drop("_enough")


def marked(docs: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    """``docs`` joined with marks by doc_id; few marks are broadcast, so that texts stay where they are."""
    return docs.join(F.broadcast(marks) if marks.count() <= BROADCAST else marks.hint("merge"), "doc_id", how)


def fit_weights(docs: DataFrame, labels: DataFrame, buckets: int) -> str:
    """Weights of the buckets in micro-nats, comma-joined, or "" without trusted documents."""
    marks = labelled(labels).where("quality = 1 and coalesce(not held, true)").select("doc_id", F.lit(1).alias("trusted"))
    words = marked(docs, marks, "left").select("trusted", words_of(F.col("text")).alias("words"))
    counts = words.select("trusted", F.explode(let(F.col("words"), lambda w: grams(w, buckets))).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("raw"), F.count("trusted").alias("target"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").fillna(0, ["raw", "target"])
    one = every.agg(F.sum("raw").alias("a"), F.sum("target").alias("b"), F.sort_array(F.collect_list(F.struct("bucket", "raw", "target"))).alias("rows"))  # one row of ``buckets`` entries
    share = lambda n, total: F.log((n + 1) / (F.col(total) + buckets))
    weight = lambda x: F.when(x["raw"] > 0, F.round(1e6 * (share(x["target"], "b") - share(x["raw"], "a")))).otherwise(F.lit(0.0)).cast("long").cast("string")
    found = one.select("b", F.array_join(F.transform("rows", weight), ",").alias("weights")).first()
    return found["weights"] if found["b"] else ""


def score_of(words: Column, weights: str, buckets: int) -> Column:
    """Mean weight of the n-grams of a text, in whole micro-nats; null for a text without words."""
    if not weights:
        return F.lit(0).cast("long")
    table = F.split(F.lit(weights), ",").cast("array<bigint>")  # folded to a constant

    total = F.aggregate(grams(words, buckets), F.lit(0).cast("long"), lambda acc, x: acc + F.get(table, x))  # the constant stands once in the plan
    return F.when(F.size(words) > 0, F.floor(total / (2 * F.size(words))).cast("long"))


def threshold(docs: DataFrame, labels: DataFrame, weights: str, buckets: int, lost: float = LOST) -> int:
    """From labelled documents that pass the base rules: halfway between the good and the bad ones, but no more than loses the share ``lost`` of the good."""
    if not weights:
        return 0
    known = marked(docs, labelled(labels).where("coalesce(held, true)"), "inner")
    # stored, since a filter would move below the join and count all documents
    scored = stored(base_counts(known, lambda w: score_of(w, weights, buckets)).select((F.col("quality") == 1).alias("good"), "base_failed", "score"), "labelled")
    found = order_statistics(scored.where(~F.col("base_failed")), "score", ["good"], [lambda n: F.floor(F.lit(lost) * n), lambda n: F.floor(F.lit(0.99) * (n - 1))])
    ends = {r["good"]: r["at"] for r in found.collect()}  # two rows
    if True not in ends:
        return -(1 << 62)
    least = ends[True][0]
    most = ends[False][1] if False in ends else least
    return (least + most) // 2 if most < least else least


def fit(docs: DataFrame, labels: DataFrame) -> tuple[object, int]:
    """The score of words as a function of columns, and the threshold."""
    given = docs.select("doc_id", "text")
    buckets = n_buckets(given)
    weights = fit_weights(given, labels, buckets)
    return lambda w: score_of(w, weights, buckets), threshold(given, labels, weights, buckets)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with the base counts, ``score`` and ``kept``."""
    score, limit = fit(docs, labels)
    out = base_counts(docs, score)
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce("score", F.lit(0)) >= F.lit(limit)))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their own columns alone."""
    score, limit = fit(docs, labels)
    return docs.where(accepted(F.col("text"), score, limit))
