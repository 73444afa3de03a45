"""Main text of pages by gradient-boosted trees over block elements, decoded along the tree.

A page becomes a tree of block elements with the text blocks between their boundaries; inline elements only mark link
text. Every block element has features of its tag, attribute tokens, ancestors, depth, siblings, and of its subtree:
text, link share, density, punctuation, share of the page. Boosted trees give each element the odds of being main text.
Decoding finds the best labelling of the whole tree in which a path from the root goes from outside to inside once and
from inside to excluded once, so that nothing is kept below an excluded element and nothing around a kept one.

Training: the pages table has no labels, so a bounded sample of its pages that mark their article is used (``SAMPLE``
pages, by a hash of the id). Each is varied: article, menu and footer under other tags and class names or none, and
pieces whose nature is known put around and into the article: sidebars, notices, adverts, forms, reader comments. Texts
for them come from other pages of the sample. An element's label is that of its nearest marked ancestor.

Defined results: null, empty or textless html gives an empty text; unclosed, crossed and cut tags are read as far as
they go: a silent element ends at its end tag or with the block around it, one that has no end tag, and ``head``, at the
next block, a self-closed one at once; a text that ends in ``<`` and no tag keeps it; without any page that marks an article plain made-up pages are used for training; repeated rows give equal texts;
other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.llm.common import slices, table
from wardflow.llm.registry import query

SAMPLE, VARIANTS, TREES, DEPTH, RATE, BINS = 150, 6, 40, 4, 0.2, 32

# Element groups of the HTML standard and usual class names.
GROUPS = [
    {"p"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"ul", "ol", "li", "dl", "dt", "dd"}, {"article", "main"}, {"div", "section", "body", "html", "center"},
    {"nav", "menu"}, {"header", "hgroup"}, {"footer"}, {"aside", "dialog"}, {"form", "fieldset", "legend", "details", "summary"},
    {"table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"blockquote", "pre", "figure", "figcaption", "address", "hr"},
]
GROUP = {tag: i for i, tags in enumerate(GROUPS) for tag in tags}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = ["script", "style", "textarea"]  # their text has no tags and runs to their end tag
SILENT = ["template", "noscript", "head", "select", "button", "svg", "iframe", "object"]
GOOD = re.compile(r"article|content|post|entry|story|body|main|text\b|prose")
POOR = re.compile(r"nav|menu|foot|head(?!line)|side|\bads?\b|advert|banner|promo|sponsor|comment|repl(?:y|ies)|cookie|consent|notice|alert|share|social|related|recommend|widget|form|login|search|subscribe|newsletter|breadcrumb|popup|modal|pager|pagination|tags|meta|toolbar|copyright|legal")

_MARK = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + "|".join(RAW) + r")\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>|<[a-zA-Z][^>]*>", re.S | re.I
)
_ATTRIBUTE = re.compile(r"(?:class|id|role|itemprop|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_SAME = {tag: re.compile(rf"<(/?){tag}\b", re.I) for tag in SILENT}
_TAG = re.compile(r"<[a-zA-Z/!?]")
_LABEL = re.compile(r"data-truth=\"([01])\"")


class Page:
    """Block elements in document order and the text blocks between their boundaries."""

    def __init__(self, source: str):
        self.group, self.good, self.poor, self.parent, self.truth = [4], [0], [0], [-1], [0]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters of it in links
        stack: list[tuple[str, int]] = [("", 0)]  # open elements, inline ones with the element of the block around
        held: list[str] = []
        links = linked = 0
        quiet, loose, inner = "", False, {}  # the silent element that is open, whether the next block ends it, tags open in it

        def flush() -> None:
            nonlocal linked
            text = " ".join("".join(held).split())
            if text:
                self.blocks.append((stack[-1][1], text, min(linked, len(text))))
            held.clear()
            linked = 0

        end = 0
        for m in _MARK.finditer(source):
            if m.start() > end:
                piece = source[end : m.start()]
                piece = entities.unescape(piece) if "&" in piece else piece
                if not quiet:
                    held.append(piece)
                    linked += len(piece) if links else 0
            end = m.end()
            if not m[3]:
                if m[1]:
                    held.append(" ")
                continue
            tag = m[3].lower()
            group = GROUP.get(tag)
            if quiet:
                if tag == quiet and m[2]:
                    quiet = ""
                    continue
                if group is None or not loose:
                    if not m[2]:
                        inner[tag] = inner.get(tag, 0) + (tag not in VOID)
                        continue
                    if group is None or inner.get(tag):
                        inner[tag] = inner.get(tag, 0) - 1
                        continue
                    if all(t != tag for t, _ in stack):
                        continue
                quiet = ""  # a block ends it
            if tag in _SAME:
                held.append(" ")
                if not m[2] and not (m[4] or "").endswith("/"):
                    after = _SAME[tag].search(source, end)
                    quiet, loose, inner = tag, tag == "head" or after is None or not after[1] and tag not in ("template", "object"), {}
                continue
            if tag == "br":
                held.append(" ")
            elif m[2]:
                if tag == "a":
                    links = max(0, links - 1)
                at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
                if at:
                    if group is not None or any(GROUP.get(t) is not None for t, _ in stack[at:]):
                        flush()
                        links = 0
                    del stack[at:]
            elif group is None:
                if tag not in VOID:
                    links += tag == "a"
                    stack.append((tag, stack[-1][1]))
            else:
                flush()
                closes = ("p",) if tag != "li" else ("p", "li")
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in closes:
                        del stack[i:]
                    elif GROUP.get(stack[i][0]) is not None:
                        break
                names = " ".join(_ATTRIBUTE.findall(m[4])).lower() if m[4] else ""
                truth = _LABEL.search(m[4]) if "data-truth" in m[4] else None
                over = stack[-1][1]
                self.group.append(group)
                self.good.append(len(GOOD.findall(names)) if names else 0)
                self.poor.append(len(POOR.findall(names)) if names else 0)
                self.parent.append(over)
                self.truth.append(int(truth[1]) if truth else self.truth[over])
                if tag not in VOID:
                    stack.append((tag, len(self.group) - 1))
        rest = source[end:]
        if rest and not quiet:
            held.append(entities.unescape(_TAG.split(rest, maxsplit=1)[0]))
        flush()


def features(pages: list[Page]) -> np.ndarray:
    """One row for every element of all pages."""
    sizes = np.array([len(p.group) for p in pages])
    first = np.cumsum(sizes) - sizes
    page = np.repeat(np.arange(len(pages)), sizes)
    n = int(sizes.sum())
    group = np.array([g for p in pages for g in p.group])
    good, poor = np.array([g for p in pages for g in p.good], dtype=float), np.array([g for p in pages for g in p.poor], dtype=float)
    parent = np.array([q + f if q >= 0 else -1 for p, f in zip(pages, first.tolist(), strict=True) for q in p.parent])
    depth = np.zeros(n, dtype=int)
    bad_above, good_above = np.zeros(n), np.zeros(n)
    bad_own = (poor > 0) | np.isin(group, (5, 6, 7, 8, 9))
    good_own = (good > poor) | (group == 3)
    pending = np.flatnonzero(parent >= 0)
    levels = [np.flatnonzero(parent < 0)]
    known = np.zeros(n, dtype=bool)
    known[levels[0]] = True
    while pending.size:
        ready = known[parent[pending]]
        now = pending[ready]
        up = parent[now]
        depth[now] = depth[up] + 1
        bad_above[now] = bad_above[up] + bad_own[up]
        good_above[now] = good_above[up] + good_own[up]
        known[now] = True
        levels.append(now)
        pending = pending[~ready]
    own = np.zeros((n, 6))  # characters, in links, blocks, words, stops, paragraphs
    start = np.full(n, np.inf)
    total = np.zeros(len(pages))
    for i, (p, f) in enumerate(zip(pages, first.tolist(), strict=True)):
        for k, (element, text, linked) in enumerate(p.blocks):
            at = f + element
            own[at] += len(text), linked, 1, text.count(" ") + 1, text.count(".") + text.count(","), 0
            start[at] = min(start[at], k)
        total[i] = max(1, len(p.blocks))
    own[:, 5] = group == 0
    sub, elements = own.copy(), np.ones(n)
    for now in reversed(levels[1:]):
        np.add.at(sub, parent[now], sub[now])
        np.add.at(elements, parent[now], elements[now])
        np.minimum.at(start, parent[now], start[now])
    up = np.maximum(parent, 0)
    order = np.lexsort((np.arange(n), parent))
    new = np.concatenate(([True], parent[order][1:] != parent[order][:-1]))
    place = np.empty(n)
    place[order] = np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0))
    count = np.bincount(parent + 1, minlength=n + 1)[parent + 1]
    alike = np.zeros(n)
    alike[order[1:]] = (group[order][1:] == group[order][:-1]) & ~new[1:]
    chars = np.maximum(1.0, sub[:, 0])
    whole = np.maximum(1.0, sub[first, 0])[page]
    flags = (group[:, None] == np.arange(len(GROUPS))).astype(float)
    return np.column_stack([
        flags, good, poor, bad_above, good_above, depth, place, count, np.where(np.isinf(start), 1.0, start / total[page]),
        np.log1p(sub[:, 0]), sub[:, 1] / chars, np.log1p(own[:, 0]), sub[:, 4] / chars, sub[:, 3] / np.maximum(1, sub[:, 2]), np.log1p(sub[:, 2]),
        elements / chars, np.log1p(sub[up, 0]), sub[:, 0] / whole, sub[:, 0] / np.maximum(1.0, sub[up, 0]), alike, sub[:, 5], flags[up, 3], bad_own,
    ])


class BoostedTrees:
    """Logistic boosting with binned features; a tree is arrays of (feature, cut) and leaf values, all of full depth."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE):
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)])
        rate_of = (weight * y).sum() / weight.sum()
        self.base = float(np.log(np.clip(rate_of, 1e-3, 1 - 1e-3) / np.clip(1 - rate_of, 1e-3, 1)))
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        score = np.full(len(y), self.base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, h = weight * (y - p), weight * p * (1 - p) + 1e-12
            feature, cut, node = np.zeros(2**depth - 1, dtype=int), np.full(2**depth - 1, BINS + 1), np.zeros(len(y), dtype=int)
            for level in range(depth):
                lo, wide = 2**level - 1, 2**level
                best = np.full(wide, 1e-6)
                for j in range(x.shape[1]):
                    key = (node - lo) * BINS + np.minimum(binned[:, j], BINS - 1)
                    gs = np.bincount(key, weights=g, minlength=wide * BINS).reshape(wide, BINS)
                    hs = np.bincount(key, weights=h, minlength=wide * BINS).reshape(wide, BINS)
                    gl, hl, ga, ha = gs.cumsum(1), hs.cumsum(1), gs.sum(1, keepdims=True), hs.sum(1, keepdims=True)
                    gain = gl**2 / (hl + 1) + (ga - gl) ** 2 / (ha - hl + 1) - ga**2 / (ha + 1)
                    at = gain.argmax(1)
                    better = gain[np.arange(wide), at] > best
                    best = np.where(better, gain[np.arange(wide), at], best)
                    feature[lo : lo + wide] = np.where(better, j, feature[lo : lo + wide])
                    cut[lo : lo + wide] = np.where(better, at, cut[lo : lo + wide])
                node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > cut[node])
            leaf = node - (2**depth - 1)
            value = rate * np.bincount(leaf, weights=g, minlength=2**depth) / (np.bincount(leaf, weights=h, minlength=2**depth) + 1)
            self.trees.append((feature, cut, value))
            score += value[leaf]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        binned = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)])
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), dtype=int)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (binned[rows, feature[node]] > cut[node])
            out += value[node - (2**DEPTH - 1)]
        return out


OUTSIDE, INSIDE, EXCLUDED = 0, 1, 2
_NEXT = {OUTSIDE: (OUTSIDE, INSIDE), INSIDE: (INSIDE, EXCLUDED), EXCLUDED: (EXCLUDED,)}


def decode(page: Page, log_odds: np.ndarray) -> list[int]:
    """The best state of every element; an element counts by its own text, and a little without any."""
    n = len(page.group)
    weight = [0.1] * n
    for element, text, _ in page.blocks:
        weight[element] += 1 + len(text) ** 0.5
    keep = [w * x for w, x in zip(weight, log_odds.tolist(), strict=True)]
    best = [[0.0, keep[i], 0.0] for i in range(n)]
    for i in range(n - 1, 0, -1):
        up, own = best[page.parent[i]], best[i]
        up[OUTSIDE] += max(own[OUTSIDE], own[INSIDE])
        up[INSIDE] += max(own[INSIDE], own[EXCLUDED])
        up[EXCLUDED] += own[EXCLUDED]
    state = [OUTSIDE] * n
    state[0] = max((OUTSIDE, INSIDE), key=lambda s: best[0][s])
    for i in range(1, n):
        state[i] = max(_NEXT[state[page.parent[i]]], key=lambda s: best[i][s])
    return state


def main_texts(sources: list[str], model: BoostedTrees) -> list[str]:
    pages = [Page(s) for s in sources]
    odds = model.log_odds(features(pages)) if pages else np.empty(0)
    out, at = [], 0
    for page in pages:
        n = len(page.group)
        state = decode(page, odds[at : at + n])
        at += n
        out.append("\n\n".join(text for element, text, _ in page.blocks if state[element] == INSIDE))
    return out


_ARTICLE = re.compile(r"<(article|main)\b[^>]*>(.*?)(?:</\1\s*>|(?=<footer\b)|\Z)", re.S | re.I)


def skeletons(n: int = 60, seed: int = 1) -> list[str]:
    """Plain pages of made-up words, for a table without pages to learn from."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(chr(97 + int(c)) for c in rng.integers(0, 26, int(rng.integers(1, 10))))
    text = lambda k: " ".join(word() for _ in range(k)).capitalize() + "."
    out = []
    for _ in range(n):
        menu = "".join(f"<li><a href=/x>{text(1)}</a></li>" for _ in range(int(rng.integers(2, 8))))
        body = "".join(f"<p>{text(int(k))} {text(int(k) // 2 + 1)}</p>" for k in rng.integers(1, 70, int(rng.integers(1, 15))))
        out.append(f"<html><body><nav><ul>{menu}</ul></nav><div class=ad>{text(6)}</div><article><h1>{text(4)}</h1>{body}</article><footer>&copy; {text(3)}</footer></body></html>")
    return out


def variants(sources: list[str], seed: int = 3, each: int = VARIANTS) -> list[str]:
    """Marked copies of pages, varied in tags, names and what stands around and in the article."""
    rng = np.random.default_rng(seed)
    texts = [b[1] for s in sources for b in Page(s).blocks] or ["Some words, as they come."]
    pick = lambda options: options[int(rng.integers(len(options)))]
    some = lambda most=4: [pick(texts)[: int(rng.integers(20, 400))] for _ in range(int(rng.integers(1, most)))]
    link = lambda: f'<a href="/x">{pick(texts)[: int(rng.integers(4, 40))]}</a>'
    links = lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(int(rng.integers(2, 9)))) + "</ul>"

    def piece(kind: str) -> str:
        open_, close = {
            "menu": pick([("<nav data-truth=\"0\">", "</nav>"), ("<div class=\"menu\" data-truth=\"0\">", "</div>"), ("<div id=\"navbar\" data-truth=\"0\">", "</div>"), ("<div data-truth=\"0\">", "</div>")]),
            "header": pick([("<header data-truth=\"0\">", "</header>"), ("<div class=\"site-header\" data-truth=\"0\">", "</div>")]),
            "footer": pick([("<footer data-truth=\"0\">", "</footer>"), ("<div class=\"footer\" data-truth=\"0\">", "</div>"), ("<div id=\"copyright\" data-truth=\"0\">", "</div>")]),
            "sidebar": pick([("<aside data-truth=\"0\">", "</aside>"), ("<div class=\"sidebar\" data-truth=\"0\">", "</div>"), ("<section class=\"related widget\" data-truth=\"0\">", "</section>")]),
            "notice": pick([("<div class=\"cookie-notice\" data-truth=\"0\">", "</div>"), ("<div role=\"alert\" data-truth=\"0\">", "</div>"), ("<dialog data-truth=\"0\">", "</dialog>")]),
            "advert": pick([("<div class=\"ad\" data-truth=\"0\">", "</div>"), ("<aside class=\"sponsored promo\" data-truth=\"0\">", "</aside>"), ("<div id=\"banner\" data-truth=\"0\">", "</div>")]),
            "form": pick([("<form action=\"/s\" data-truth=\"0\">", "</form>"), ("<div class=\"newsletter subscribe\" data-truth=\"0\"><form>", "</form></div>")]),
            "comments": pick([("<section class=\"comments\" data-truth=\"0\">", "</section>"), ("<div id=\"comments\" data-truth=\"0\">", "</div>"), ("<div class=\"reader-replies\" data-truth=\"0\">", "</div>")]),
        }[kind]
        if kind in ("menu", "sidebar") and rng.random() < 0.7:
            return open_ + links() + close
        if kind == "comments":
            return open_ + "".join(f"<div class=\"comment\"><p>{t}</p></div>" if rng.random() < 0.6 else f"<p>{t}</p>" for t in some(6)) + close
        wrap = pick(["{}", "<p>{}</p>", "<span>{}</span>"])
        return open_ + "".join(wrap.format(t) for t in some(3)) + close

    out = []
    for source in sources:
        found = _ARTICLE.search(source)
        if not found:
            continue
        before, inner, after = source[: found.start()], found[2], source[found.end() :]
        for k in range(each):
            open_, close = pick([("<article data-truth=\"1\">", "</article>"), ("<main data-truth=\"1\">", "</main>"), ("<div class=\"post-content\" data-truth=\"1\">", "</div>"), ("<div class=\"entry\" data-truth=\"1\">", "</div>"), ("<div data-truth=\"1\">", "</div>"), ("<section id=\"story\" data-truth=\"1\">", "</section>")])
            if k == 0:
                out.append(f'{before}<article data-truth="1">{inner}</article>{after}')
                continue
            body = inner
            for kind in ("advert", "notice", "form", "comments", "sidebar"):
                if rng.random() < 0.3:
                    at = pick([m.end() for m in re.finditer(r"</p>|</h1>", body)] or [len(body)]) if kind != "comments" else len(body)
                    body = body[:at] + piece(kind) + body[at:]
            head = "".join(piece(kind) for kind in ("menu", "header", "notice", "advert") if rng.random() < 0.5)
            tail = "".join(piece(kind) for kind in ("comments", "sidebar", "form", "advert", "footer") if rng.random() < 0.5)
            frame = pick([("", ""), ("<div id=\"page\">", "</div>"), ("<div><div class=\"wrap\">", "</div></div>")])
            around = (before, after) if rng.random() < 0.5 else ("<html><body>", "</body></html>")
            out.append(around[0] + frame[0] + head + open_ + body + close + tail + frame[1] + around[1])
    return out


def train(sources: list[str]) -> BoostedTrees:
    pages = [Page(s) for s in variants(sources) or variants(skeletons())]
    y = np.array([t for p in pages for t in p.truth], dtype=float)
    x = features(pages)
    own = np.concatenate([np.bincount([b[0] for b in p.blocks], weights=[len(b[1]) for b in p.blocks], minlength=len(p.group)) if p.blocks else np.zeros(len(p.group)) for p in pages])
    return BoostedTrees(x, y, 0.3 + np.log1p(own))


def learn(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE) -> BoostedTrees:
    """Trees from a bounded sample of pages that mark an article, none longer than 100,000 characters."""
    marked = pages.where(F.col(html_col).rlike(r"(?i)<(article|main)\b") & (F.length(html_col) <= 100_000))
    # ids first: a head of whole pages from every task would grow with the tasks
    ids = marked.select(F.col(id_col).alias("picked")).distinct().orderBy(F.xxhash64("picked"), "picked").limit(sample)
    picked = marked.join(F.broadcast(ids), F.col(id_col) == F.col("picked"), "left_semi").dropDuplicates([id_col])
    return train([r[0] for r in picked.select(html_col, id_col).orderBy(id_col).collect()])


def extract(pages: DataFrame, model: BoostedTrees, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) per row, in place."""
    shared = pages.sparkSession.sparkContext.broadcast(model)
    rows = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), "url")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch):
                texts = main_texts(some.column(1).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([some.column(0).cast(pa.int64()), some.column(2), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(read, "page_id long, url string, text string, n_chars long")


@query("op9_boosted_dom_nodes")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return extract(pages, learn(pages))
