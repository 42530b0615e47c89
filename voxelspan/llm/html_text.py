"""Main text of web pages by maximum-scoring subsequence.

A page is read once into tags and runs of words. Each word scores by where it stands, each tag negative, with weights
learned from labelled pages; one linear scan finds the contiguous stretch with the highest sum. Its blocks, without those
whose own words sum to less than nothing (an advert or a form amid the text), are the text.

A word's score is ``2 p - 1``, where p is the probability that a word with its features lies in the content: the elements
and class names around it, whether it stands in a link, and length and share of links of its block. p comes from a logistic
regression. No element or name decides by itself, and elements that mark content (``article``, ``main``, ``section``) are
no features at all: they are read as ``div``, so a page gives the same text without them. A tag scores between -0.05 and -1.05 by the share of
its name that lies outside the content. Words below nothing count ``BELOW`` of their score, so that a long advert does not tear a text apart.

Labelled pages are those of ``examples()``, which are made by rule, and at most ``SAMPLE`` pages of the table, in the order
of a hash: of these, pages with one outermost ``article`` or ``main`` that holds half of their words or more. The two kinds
have equal weight; a feature must occur in ``LEAST_WORDS`` labelled words, and the ``FEATURES`` most frequent are learned.

Defined results: a null or blank page has the empty text; a page without words that score above nothing has the empty
text; among equal sums the first stretch wins; repeated rows are read each for itself; an empty table gives no rows;
further columns are ignored. Unclosed elements end with their parent; what follows an unclosed comment, script or
style is part of it. Of more than ``AROUND`` names around a word the nearest count.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE, FEATURES, LEAST_WORDS, AROUND = 1_000, 800, 5, 64
BELOW = 0.25
#: Labelled words that each kind of labelled pages counts for.
WEIGHT = 10_000
TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<(script|style|textarea|title|noscript|template|iframe|svg|xmp|object)\b(?:[^>"']|"[^"]*"|'[^']*')*(?<!/)>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'<]|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S | re.I)
ATTRIBUTE = re.compile(r"""([a-zA-Z:_-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Element names by their part in HTML. Fixed values.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MARKS_CONTENT = frozenset(("article", "main"))
PLAIN = frozenset("html body div article main section span center font tbody thead".split())
SMALL = frozenset("p h1 h2 h3 h4 h5 h6 span b i em strong small a li td th tr dt dd figcaption img br code time cite q sub sup u font label".split())
CLOSES = {"p": frozenset(("p",)), "li": frozenset(("li", "p")), "dt": frozenset(("dt", "dd", "p")), "dd": frozenset(("dt", "dd", "p")), "tr": frozenset(("td", "th", "tr", "p")), "td": frozenset(("td", "th", "p")), "th": frozenset(("td", "th", "p")), "option": frozenset(("option",))}
#: Class names that the made examples use around content and around other parts. Fixed values.
GOOD_NAMES = "content post entry story article text body page article-body post-content entry-content main-content post-header entry-header article-header post-title entry-title post-body story-body page-content articleBody post-meta entry-summary wrapper container row inner layout column site-content site-main page-body top-story bottom-text my-post side-story content-box text-list post-area entry-wrap story-section text-block body-container post-item".split()
STATE_NAMES = "comments-open ads-enabled has-sidebar no-sidebar sharing-disabled no-comments banner-on newsletter-on".split()
BAD_NAMES = "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification popup modal newsletter subscribe subscription signup sidebar widget related recommended recommendations share sharing social comment comments disqus respond replies nav navbar navigation menu breadcrumb breadcrumbs footer header masthead toolbar pagination pager login search skip alert disclaimer".split()
BAD_ROLES = "navigation banner contentinfo complementary search alert dialog form menu toolbar".split()

Run = tuple[str, str, tuple[str, ...], int, int]  # tag name or "", text, features of its place, block, label


def own_features(name: str, attributes: str, top: bool) -> list[str]:
    """Features that an element gives to all words in it. top: it stands right in the body."""
    out = [] if name in PLAIN else [f"t:{name}^" if top and name in ("header", "footer") else f"t:{name}"]
    if not attributes or name in ("html", "body"):
        return out
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", "").lower():
            out.append("hidden")
        elif key == "role":
            out.append(f"r:{value.lower()}")
        elif key in ("class", "id"):
            for one in value.split():
                words = [w.lower() for w in NAME.findall(one)]
                if name in SMALL:
                    out.append(f"l:{one.lower()}")
                elif len(words) == 1:
                    out.append(f"c:{words[0]}")
                elif words:
                    out += [f"f:{words[0]}", f"z:{words[-1]}"]
    return out


def events(page: str) -> Iterator[Run]:
    """Tags and runs of text in page order.

    block: number of the block a run belongs to. label: 1 inside an ``article`` or ``main``, 0 outside and inside an
    element with ``data-no``, which the made examples use.
    """
    stack: list[tuple[str, tuple[str, ...], int]] = []  # name, features, label
    opened: Counter = Counter()
    around: tuple[str, ...] = ()
    block = at = label = 0

    def pop() -> None:
        nonlocal around, label
        opened[stack.pop()[0]] -= 1
        around, label = stack[-1][1:] if stack else ((), 0)

    for m in TOKEN.finditer(page):
        if m.start() > at:
            yield "", page[at : m.start()], around, block, label
        at = m.end()
        name = (m[3] or m[6] or "").lower()
        if not name:
            if m[1]:
                yield m[1].lower(), "", around, block, label
            continue
        block += name in BLOCK
        shown = "div" if name in PLAIN else name
        if m[2] or m[5]:
            yield shown, "", around, block, label
            if opened[name]:
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        while stack and stack[-1][0] in CLOSES.get(name, ()):
            pop()
        attributes = m[4] if m[4] is not None else m[7]
        if name not in VOID and not (attributes.endswith("/") and name not in BLOCK):
            own = own_features(name, attributes, not stack or stack[-1][0] in ("html", "body"))
            if own:
                around = tuple(dict.fromkeys((*own, *around)))[:AROUND]
            label = 0 if "data-no" in attributes else 1 if name in MARKS_CONTENT and not opened["aside"] else label
            stack.append((name, around, label))
            opened[name] += 1
        yield shown, "", around, block, label
    if at < len(page):
        yield "", page[at:], around, block, label


def block_features(runs: list[Run]) -> tuple[str, ...]:
    """Features of a block: its length in words and whether half of them are links."""
    n = sum(len(r[1].split()) for r in runs)
    links = sum(len(r[1].split()) for r in runs if "t:a" in r[2])
    return f"words:{min(n, 2) if n <= 2 else 3 if n <= 6 else 4 if n <= 20 else 5}", *(("links",) if 2 * links > n else ())


def with_blocks(page: str) -> list[tuple[Run, tuple[str, ...]]]:
    """The events, each run of text with the features of its block."""
    seen = list(events(page))
    held: dict[int, list[Run]] = {}
    for r in seen:
        if r[1]:
            held.setdefault(r[3], []).append(r)
    own = {k: block_features(v) for k, v in held.items()}
    return [(r, own[r[3]] if r[1] else ()) for r in seen]


def labelled(page: str, must_mark: bool) -> tuple[Counter, Counter]:
    """Words by (features, label) and tags by (name, label). must_mark: only of pages with one content element that holds half of the words."""
    words, tags = Counter(), Counter()
    stretches, last = 0, 0
    for (name, text, around, _, label), own in with_blocks(page):
        stretches += label > last
        last = label
        if name:
            tags[name, label] += 1
        elif n := len(text.split()):
            words[" ".join((*own, *around)), label] += n
    inside, total = sum(n for (_, y), n in words.items() if y), sum(words.values())
    if must_mark and (stretches != 1 or 2 * inside < total):
        return Counter(), Counter()
    return words, tags


def examples() -> Iterator[str]:
    """Labelled pages made by rule: content in ``main``, other parts outside it or under ``data-no``."""
    text = lambda n: " ".join(["word"] * n)
    links = lambda n: "".join(f"<li><a href='/{k}'>{text(1 + k % 3)}</a></li>" for k in range(n))
    for k, bad in enumerate(name for name in BAD_NAMES for _ in range(5)):
        good, other = GOOD_NAMES[k % len(GOOD_NAMES)], GOOD_NAMES[(7 * k + 3) % len(GOOD_NAMES)]
        state = f" {STATE_NAMES[k % len(STATE_NAMES)]}" if k % 3 == 0 else ""
        ending = ("box", "list", "area", "wrap", "section", "block", "container", "item")[k % 8]
        part = (f"<p>{text(4 + 9 * (k % 3))}</p>", f"<ul>{links(5)}</ul>", f"{text(6)}<br>{text(12)}", f"<h3>{text(2)}</h3><div><p>{text(25)}</p></div><p>{text(9)}</p>", f"<h4>{text(2)}</h4><ul><li>{text(3)}</li><li>{text(4)}</li></ul>")[k % 5]
        named = (f'class="{bad}"', f'id="{bad}"', f'class="{bad}-{ending}"', f'class="{("site", "page", "top", "bottom", "my", "side")[k % 6]}-{bad}"', f'role="{BAD_ROLES[k % len(BAD_ROLES)]}"')
        shut = lambda j, part=part, named=named: f"<{('div', 'section', 'aside', 'div')[j % 4]} {named[j % 5]} data-no>{part}</{('div', 'section', 'aside', 'div')[j % 4]}>"
        told = [f"<p>{text(30 + 11 * (k % 4))}</p>", f"<p>{text(12)} <a href='/x'>{text(3)}</a> {text(9)}<br>{text(4)}</p>", f"<ul><li>{text(2)}</li><li>{text(7)}</li></ul>", f"<blockquote><p>{text(14)}</p></blockquote>",
                f"<h2>{text(3)}</h2>", f"<table><tr><th>{text(1)}</th><td>{text(3)}</td></tr></table>", f"<p><b>{text(3)}</b> {text(20)} <em>{text(2)}</em></p>", f"<figure><img src=a><figcaption>{text(6)}</figcaption></figure>",
                f"<pre><code>{text(9)}</code></pre>", f"<p>{text(3)}</p>", f"<div>{text(40)}</div>", f"<dl><dt>{text(1)}</dt><dd>{text(6)}</dd></dl>", f'<p class="{bad}-note">{text(10)}</p>', f"<ol><li><p>{text(15)}</p></li></ol>", f"<ul><li>{text(1)}</li><li>{text(1)}</li><li>{text(1)}</li></ul>", f"<p>{text(1)}</p>",
                f"<p><a href='/z'>{text(4)}</a></p>", f"<p>{text(2)}</p><p>{text(5)}</p>", f"<p><a href='/z'>{text(1)}</a></p><p>{text(18)}</p>"]
        body = [told[(k * 5 + j) % len(told)] for j in range(7)]
        head = (f"<h1>{text(6)}</h1>", f"<header><h1>{text(5)}</h1><p>{text(4)}</p></header>", f'<div class="{other}"><h1>{text(1)}</h1></div>', f"<h1>{text(2)}</h1><p><a href=/y>{text(5)}</a></p>")[k % 4]
        menu = (f"<nav><ul>{links(6)}</ul></nav>", f'<div class="menu"><ul>{links(5)}</ul></div>', f"<header><a href=/>{text(2)}</a><nav><ul>{links(4)}</ul></nav></header>", f"<div><ul>{links(6)}</ul></div>", f"<header><p>{text(3)}</p></header><nav><a href=/a>{text(1)}</a> <a href=/b>{text(2)}</a></nav>")[k % 5]
        form = (f"<form><label>{text(2)}</label><input><select><option>{text(1)}</option></select><button>{text(1)}</button></form>", "")[k % 2]
        foot = (f"<footer>{text(5 + 10 * (k % 3))}</footer>", f"<footer><p>{text(8)}</p><ul>{links(4)}</ul></footer>", f'<div id="footer"><p>{text(12)}</p></div>')[k % 3]
        aside = (f"<aside><h3>{text(2)}</h3><p>{text(18)}</p></aside>", f"<aside><ul>{links(6)}</ul></aside>", f'<div class="comments"><div class="comment"><p>{text(16)}</p></div><div class="comment"><p>{text(5)}</p></div></div>', f'<div hidden><p>{text(10)}</p></div>')[k % 4]
        inner = "".join([head, *body[:4], shut(k), *body[4:]]) if k % 2 else "".join([head, *body])
        main = f'<main class="{good}{state}">' if k % 3 == 0 else "<main>"
        outer = f'<div class="{other}">' if k % 4 == 0 else "<div>"
        yield f"<main>{''.join(told[(k + 3 * j) % len(told)] for j in range(5))}</main>"
        yield f'<body>{menu}{shut(k + 1)}{outer}{main}{inner}{form and f"<div data-no>{form}</div>"}</main></div>{shut(k + 2)}{aside}{form}{shut(k + 3)}{foot}</body>'


class Model:
    """Weights of the features of words, and of tags."""

    def __init__(self, features: dict[str, float], bias: float, tags: dict[str, float]):
        self.features, self.bias, self.tags = features, bias, tags
        self.known: dict[tuple[tuple[str, ...], tuple[str, ...]], float] = {}

    def word(self, around: tuple[str, ...], own: tuple[str, ...]) -> float:
        """Score of a word, between -1 and 1."""
        key = around, own
        if key not in self.known:
            if len(self.known) > 50_000:
                self.known.clear()
            z = self.bias + sum(self.features.get(f, 0.0) for f in dict.fromkeys((*around, *own)))
            self.known[key] = float(np.tanh(z / 2))
        return self.known[key]

    def tag(self, name: str) -> float:
        return self.tags.get(name, -0.5)


def train(parts: list[tuple[Counter, Counter]], ridge: float = 0.3, rounds: int = 15) -> Model:
    """Logistic regression by Newton's method on the words of each part; parts have equal weight."""
    weigh = [(c, WEIGHT / max(1, sum(c.values()))) for c, _ in parts]
    total: Counter = Counter()
    for c, _ in weigh:
        for (f, _), n in c.items():
            for x in f.split(" "):
                total[x] += n
    names = [f for f, n in total.most_common(FEATURES) if n >= LEAST_WORDS]
    place = {f: k for k, f in enumerate(names)}
    rows = [(f, y, n * w) for c, w in weigh for (f, y), n in sorted(c.items())]
    x = np.zeros((len(rows), len(names) + 1))
    x[:, -1] = 1
    for k, (f, _, _) in enumerate(rows):
        x[k, [place[g] for g in f.split(" ") if g in place]] = 1
    y, w = np.asarray([r[1] for r in rows], float), np.asarray([r[2] for r in rows])
    a, hold = np.zeros(len(names) + 1), np.append(np.full(len(names), ridge), 1e-6)  # the bias is free
    for _ in range(rounds if len(rows) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        h = x.T @ (x * (w * p * (1 - p))[:, None]) + np.diag(hold)
        a = a - np.linalg.solve(h, x.T @ (w * (p - y)) + hold * a)
    tags: Counter = Counter()
    for _, c in parts:
        scale = WEIGHT / max(1, sum(c.values()))
        for k, n in c.items():
            tags[k] += n * scale
    outside = {t: (tags[t, 0] + 0.5) / (tags[t, 0] + tags[t, 1] + 1) for t, _ in tags}
    return Model(dict(zip(names, a[:-1].tolist(), strict=True)), float(a[-1]), {t: -0.05 - v for t, v in outside.items()})


def gains(seen: list[tuple[Run, tuple[str, ...]]], model: Model) -> list[float]:
    """What each event adds to a stretch."""
    out = []
    for (name, text, around, _, _), own in seen:
        if name:
            out.append(model.tag(name) * 0.1)
        else:
            s = model.word(around, own) * len(text.split())
            out.append(s if s > 0 else BELOW * s)
    return out


def best_stretch(gain: list[float]) -> tuple[int, int] | None:
    """First and last event of the stretch with the highest sum, the first of equal ones; None if no sum is above nothing."""
    best = total = 0.0
    start, span = 0, None
    for k, g in enumerate(gain):
        if total <= 0:
            total, start = 0.0, k
        total += g
        if total > best:
            best, span = total, (start, k)
    return span


def main_text(page: str | None, model: Model) -> str:
    if not page:
        return ""
    seen = with_blocks(page)
    span = best_stretch(gains(seen, model))
    if span is None:
        return ""
    lines = []
    for _, runs in groupby(seen[span[0] : span[1] + 1], key=lambda e: e[0][3]):
        held, score = [], 0.0
        for (name, text, around, _, _), own in runs:
            if text:
                held.append(text)
                score += model.word(around, own) * len(text.split())
            elif name == "br":
                held.append(" ")
        line = " ".join(html.unescape("".join(held)).split()) if score > 0 else ""
        if line:
            lines.append(line)
    return "\n".join(lines)


def example_counts() -> tuple[Counter, Counter]:
    words, tags = Counter(), Counter()
    for page in examples():
        a, b = labelled(page, False)
        words.update(a)
        tags.update(b)
    return words, tags


def fit(pages: DataFrame, most: int = SAMPLE) -> Model:
    """Weights from the made examples and at most ``most`` pages that mark their content."""
    marked = pages.select("page_id", "html").where(F.lower("html").rlike("<(article|main)[ >]"))
    names = marked.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(most)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, tags = Counter(), Counter()
        for batch in batches:
            for page in batch.column("html").to_pylist():
                a, b = labelled(page, True)
                words.update(a)
                tags.update(b)
        rows = [{"kind": kind, "name": f, "inside": y, "n": n} for kind, c in (("word", words), ("tag", tags)) for (f, y), n in c.items()]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("kind", pa.string()), ("name", pa.string()), ("inside", pa.int32()), ("n", pa.int64())]))

    sample = marked.join(F.broadcast(names), "page_id").select("html").mapInArrow(count, "kind string, name string, inside int, n long")  # bounded by `most`
    words, tags = Counter(), Counter()
    for r in sample.groupBy("kind", "name", "inside").agg(F.sum("n").alias("n")).collect():  # patterns of at most `most` pages
        (words if r["kind"] == "word" else tags)[r["name"], r["inside"]] += r["n"]
    return train([example_counts()] + [(words, tags)] * bool(words))


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url and main text of every page."""
    model = model or fit(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, model) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    given = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return given.mapInArrow(run, "page_id long, url string, text string")
