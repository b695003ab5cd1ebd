"""Main text of web pages: boosted trees score the nodes of a page, a pass over the tree chooses among them."""

from __future__ import annotations

import hashlib
import html
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dumpsieve.llm.shared import text_chunks

# Fixed lists: elements of HTML, and words that class, id and role attributes use.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes".split())
NEVER_TEXT = RAW | frozenset("head svg math canvas object audio video select option button map".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul".split()
)
#: An open element of the key ends where one of these begins, unless a container lies between.
CLOSED_BY = {
    "p": BLOCK - {"html", "head", "body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option"},
    "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"}, "head": {"body"},
}
CONTAINERS = frozenset("ul ol dl table div section article main aside nav header footer form body td th blockquote".split())
WORDS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc skip tabs",
    "header": "header masthead topbar branding logo tagline banner hero",
    "footer": "footer copyright colophon legal imprint",
    "sidebar": "sidebar aside rail related recommended widget trending popular share social tags more complementary",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay newsletter subscribe paywall toast message",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted adsbygoogle promotion outbrain taboola",
    "form": "form search login signup signin register contact",
    "comments": "comment comments reply replies respond disqus discussion reader readers",
    "content": "article post entry content main story body text prose document page",
}
_TOKENS = {word: kind for kind, words in WORDS.items() for word in words.split()}
_KINDS = tuple(WORDS)
_TAG_KINDS = {"nav": "menu", "header": "header", "footer": "footer", "aside": "sidebar", "form": "form", "article": "content", "main": "content"}
_TAGS = ("article main section div p span a b li ul ol nav header footer aside form h1 h2 h3 table td blockquote pre figure body").split()

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Page:
    """Elements in document order; 0 is the page itself. ``parts`` are texts, or None where a block ends."""

    tags: list[str] = field(default_factory=lambda: ["#page"])
    parents: list[int] = field(default_factory=lambda: [-1])
    kinds: list[frozenset[str]] = field(default_factory=lambda: [frozenset()])
    dead: list[bool] = field(default_factory=lambda: [False])
    label: list[int] = field(default_factory=lambda: [-1])
    parts: list[tuple[int, str | None]] = field(default_factory=list)


def _attributes(raw: str) -> tuple[frozenset[str], bool, int]:
    """Kinds of words in class, id and role; whether it is hidden; a training label or -1."""
    if not raw or raw.isspace() or raw == "/":
        return frozenset(), False, -1
    kinds, hidden, label = set(), False, -1
    for m in _ATTRIBUTE.finditer(raw):
        name, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
        if name in ("class", "id", "role", "aria-label"):
            kinds.update(_TOKENS[w] for w in map(str.lower, _WORD.findall(value)) if w in _TOKENS)
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
            hidden = True
        elif name == "data-taught":
            label = int(value == "1")
    return frozenset(kinds), hidden, label


def parse(source: str) -> Page:
    """Elements and texts of a page; end tags that are missing or wrong are made up for."""
    page = Page()
    stack, at, size = [0], 0, len(source)

    def close_to(depth: int) -> None:
        while len(stack) > depth:
            if page.tags[stack.pop()] in BLOCK:
                page.parts.append((stack[-1], None))

    while at < size:
        m = _MARKUP.search(source, at)
        end = m.start() if m else size
        if end > at:
            page.parts.append((stack[-1], source[at:end]))
        if not m:
            break
        at = m.end()
        if not m.group(2):
            if m.group().startswith("<![CDATA["):
                page.parts.append((stack[-1], m.group()[9:].removesuffix("]]>")))
            continue
        tag = m.group(2).lower()
        if m.group(1):
            for depth in range(len(stack) - 1, 0, -1):
                if page.tags[stack[depth]] == tag:
                    close_to(depth)
                    break
                if page.tags[stack[depth]] in CONTAINERS and tag not in CONTAINERS:
                    break
            continue
        for depth in range(len(stack) - 1, 0, -1):
            open_ = page.tags[stack[depth]]
            if tag in CLOSED_BY.get(open_, ()):
                close_to(depth)
                break
            if open_ in CONTAINERS:
                break
        if tag in BLOCK:
            page.parts.append((stack[-1], None))
        elif tag == "br":
            page.parts.append((stack[-1], " "))
        kinds, hidden, label = _attributes(m.group(3))
        node = len(page.tags)
        page.tags.append(tag)
        page.parents.append(stack[-1])
        page.kinds.append(kinds)
        page.dead.append(hidden or tag in NEVER_TEXT or page.dead[stack[-1]])
        page.label.append(label)
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(source, at)
            at = close.end() if close else size
        elif tag not in VOID and not m.group(3).endswith("/"):
            stack.append(node)
    return page


_TAG_AT = {tag: i for i, tag in enumerate(_TAGS)}
_KIND_AT = {kind: i for i, kind in enumerate(_KINDS)}


def node_features(page: Page) -> np.ndarray:
    """One row per element."""
    n = len(page.tags)
    parents = np.array(page.parents)
    own = np.zeros(n)
    for node, text in page.parts:
        if text is not None and not page.dead[node]:
            own[node] += len(text) if not text.isspace() else 0
    text, tags, prose = own.copy(), np.ones(n), np.zeros(n)
    links = np.array([t == "a" for t in page.tags], float)
    depth, children, rank = np.zeros(n), np.zeros(n), np.zeros(n)
    named, above, is_tag = np.zeros((n, len(_KINDS)), bool), np.zeros((n, len(_KINDS)), bool), np.zeros((n, len(_TAGS)), bool)
    for i in range(n):
        p = parents[i]
        if i:
            depth[i], rank[i] = depth[p] + 1, children[p]
            children[p] += 1
            above[i] = above[p] | named[p]
        for kind in page.kinds[i]:
            named[i, _KIND_AT[kind]] = True
        tag = page.tags[i]
        if tag in _TAG_KINDS:
            named[i, _KIND_AT[_TAG_KINDS[tag]]] = True
        if tag in _TAG_AT:
            is_tag[i, _TAG_AT[tag]] = True
        if page.tags[i] == "p":
            prose[i] = text[i]
    in_link = np.zeros(n, bool)
    for i in range(1, n):
        in_link[i] = in_link[parents[i]] or page.tags[i] == "a"
    linked = own * in_link
    for i in range(n - 1, 0, -1):
        p = parents[i]
        for sums in (text, linked, tags, prose, links):
            sums[p] += sums[i]
    safe = np.maximum(parents, 0)
    log = np.log1p
    numbers = np.stack([
        depth, log(text), log(own), log(prose), linked / (text + 1), links / tags, log(text / tags), log(tags),
        children, children[safe] * (parents >= 0), rank / np.maximum(children[safe], 1), text / (text[safe] + 1),
        text / (text[0] + 1), in_link,
    ], axis=1)
    of_parent = named[safe] & (parents >= 0)[:, None]
    return np.concatenate([is_tag, named, above, of_parent, numbers], axis=1).astype(np.float32)


# ---------------------------------------------------------------- boosted trees


@dataclass(frozen=True)
class Boosting:
    trees: int = 40
    depth: int = 4
    bins: int = 32
    rate: float = 0.25
    least: int = 20
    ridge: float = 1.0


@dataclass(frozen=True)
class Forest:
    """Complete binary trees of one depth: feature and cut of each inner node, value of each leaf."""

    features: np.ndarray
    cuts: np.ndarray
    values: np.ndarray
    base: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.features.shape[1]
        for feature, cut, value in zip(self.features, self.cuts, self.values):
            at = np.zeros(len(x), np.int64)
            while at.size and at[0] < inner:
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += value[at - inner]
        return out


def fit_forest(x: np.ndarray, y: np.ndarray, options: Boosting) -> Forest:
    """Logistic loss, second order, on histograms of the features."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, options.bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], axis=1)
    share = np.clip(y.mean(), 0.01, 0.99)
    base = float(np.log(share / (1 - share)))
    odds = np.full(len(x), base)
    inner = 2**options.depth - 1
    features, cuts, values = [], [], []
    for _ in range(options.trees):
        p = 1 / (1 + np.exp(-odds))
        slope, curve = y - p, p * (1 - p)
        feature, cut, at = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32), np.zeros(len(x), np.int64)
        for level in range(options.depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-3)
            for f in range(x.shape[1]):
                if not len(edges[f]):
                    continue
                n_bins = len(edges[f]) + 1
                place = (at - first) * n_bins + binned[:, f]
                g, h, n = (np.bincount(place, weights=w, minlength=width * n_bins).reshape(width, n_bins).cumsum(1) for w in (slope, curve, np.ones(len(x))))
                left, right = (g[:, :-1], h[:, :-1]), (g[:, -1:] - g[:, :-1], h[:, -1:] - h[:, :-1])
                gain = sum(a**2 / (b + options.ridge) for a, b in (left, right)) - g[:, -1:] ** 2 / (h[:, -1:] + options.ridge)
                gain = np.where((n[:, :-1] >= options.least) & (n[:, -1:] - n[:, :-1] >= options.least), gain, -1)
                top = gain.argmax(1)
                better = gain[np.arange(width), top] > best
                best = np.where(better, gain[np.arange(width), top], best)
                feature[first : first + width][better] = f
                cut[first : first + width][better] = edges[f][top[better]]
            at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > cut[at])
        leaf = at - inner
        g, h = (np.bincount(leaf, weights=w, minlength=inner + 1) for w in (slope, curve))
        value = options.rate * g / (h + options.ridge)
        odds += value[leaf]
        features.append(feature)
        cuts.append(cut)
        values.append(value)
    return Forest(np.stack(features), np.stack(cuts), np.stack(values), base)


# ---------------------------------------------------------------- what pages teach

_ARTICLE = re.compile(r"<(article|main)\b[^>]*>(.*)</\1\s*>", re.S | re.I)
# Ways to write the parts of a page; what is taught is the kind of part, whatever its markup.
_CONTENT = (
    "<article {}>|</article>", "<main {}>|</main>", "<main {}><article>|</article></main>", '<div class="post-content" {}>|</div>',
    '<div id="content" {}>|</div>', '<section class="story" {}>|</section>', '<div role="main" {}>|</div>', '<div class="entry" {}>|</div>',
    '<div class="article-body" {}>|</div>', "<div {}>|</div>", "<div {}><div>|</div></div>",
)
_MENU = ("<nav {}>|</nav>", '<div class="menu" {}>|</div>', '<div id="nav" {}>|</div>', '<div class="breadcrumbs" {}>|</div>', "<div {}>|</div>")
_HEADER = ("<header {}>|</header>", '<div class="site-header" {}>|</div>', '<div id="header" {}>|</div>')
_FOOTER = ("<footer {}>|</footer>", '<div class="footer" {}>|</div>', '<div id="footer" {}>|</div>', '<div class="copyright" {}>|</div>')
_SIDE = ("<aside {}>|</aside>", '<div class="sidebar" {}>|</div>', '<div id="sidebar" {}>|</div>', '<div class="related" {}>|</div>', '<section class="widget" {}>|</section>')
_NOTICE = ('<div class="cookie-notice" {}>|</div>', '<div id="consent" {}>|</div>', '<div class="newsletter" {}>|</div>', '<div class="notice" {}>|</div>', '<div role="alert" {}>|</div>')
_ADVERT = ('<div class="ad" {}>|</div>', '<div class="advert" {}>|</div>', '<aside class="sponsored" {}>|</aside>', '<div class="promo" {}>|</div>', '<ins class="adsbygoogle" {}>|</ins>')
_FORM = ("<form {}>|</form>", '<form class="search" {}>|</form>', '<form id="contact" {}>|</form>')
_COMMENTS = ('<section id="comments" {}>|</section>', '<div class="comments" {}>|</div>', '<div class="comment-list" {}>|</div>', '<section class="reader-comments" {}>|</section>')


def _wrapped(chance: random.Random, forms: tuple[str, ...], body: str, taught: int) -> str:
    front, back = chance.choice(forms).split("|")
    return front.format(f'data-taught="{taught}"') + body + back


def taught_pages(sources: list[str]) -> list[str]:
    """Pages with marked parts, put together anew from articles that the sources mark up as such.

    The texts are the sources' own; the other parts around an article take words of other pages.
    """
    bodies = []
    for source in sources:
        m = _ARTICLE.search(re.sub(r"<!--.*?-->", "", source, flags=re.S))
        if m:
            bodies.append(re.sub(r"<(nav|aside|form|footer|script|style)\b.*?</\1\s*>", "", m.group(2), flags=re.S | re.I))
    out = []
    for number, body in enumerate(bodies):
        chance = random.Random(int(hashlib.md5(body.encode("utf-8", "replace")).hexdigest()[:8], 16))
        words = re.sub(r"<[^>]*>", " ", chance.choice(bodies)).split() or ["word"]

        def some(least: int, most: int) -> str:
            at = chance.randrange(len(words))
            return " ".join((words[at:] + words)[: chance.randint(least, most)])

        def items(n: int) -> str:
            return "<ul>" + "".join(f'<li><a href="/x">{some(1, 5)}</a></li>' for _ in range(n)) + "</ul>"

        for _ in range(2):
            front = [_wrapped(chance, _MENU, items(chance.randint(2, 9)), 0)]
            if chance.random() < 0.5:
                front.append(_wrapped(chance, _HEADER, f"<{chance.choice(['h1', 'p', 'div'])}>{some(1, 8)}", 0))
            if chance.random() < 0.6:
                front.append(_wrapped(chance, _ADVERT, some(3, 30), 0))
            if chance.random() < 0.4:
                front.append(_wrapped(chance, _NOTICE, f"<p>{some(5, 40)}</p>", 0))
            back = []
            if chance.random() < 0.5:
                back.append(_wrapped(chance, _SIDE, f"<h3>{some(1, 3)}</h3>" + items(chance.randint(2, 8)) + f"<p>{some(4, 30)}</p>", 0))
            if chance.random() < 0.4:
                back.append(_wrapped(chance, _FORM, f"<label>{some(1, 4)}</label><input><p>{some(2, 10)}</p>", 0))
            if chance.random() < 0.5:
                said = "".join(f'<div class="comment"><b>{some(1, 2)}</b><p>{some(5, 80)}</p></div>' for _ in range(chance.randint(1, 5)))
                back.append(_wrapped(chance, _COMMENTS, said, 0))
            if chance.random() < 0.3:
                back.append(_wrapped(chance, _ADVERT, some(3, 30), 0))
            chance.shuffle(front)
            chance.shuffle(back)
            cut = [m.start() for m in re.finditer(r"<p\b", body)]
            inner = body[: chance.choice(cut[1:])] if len(cut) > 1 and chance.random() < 0.3 else body
            if chance.random() < 0.3:  # an advert amid the paragraphs
                cut = [at for at in cut[1:] if at < len(inner)]
                if cut:
                    at = chance.choice(cut)
                    inner = inner[:at] + _wrapped(chance, _ADVERT + _SIDE, f"<p>{some(3, 25)}</p>", 0) + inner[at:]
            content = _wrapped(chance, _CONTENT, inner, 1)
            if chance.random() < 0.5:
                content = f"<div>{content}</div>" if chance.random() < 0.5 else f'<div class="wrapper" id="page">{content}</div>'
            foot = _wrapped(chance, _FOOTER, f"&copy; <p>{some(3, 20)}</p>" if chance.random() < 0.5 else f"&copy; {some(3, 20)}", 0)
            out.append("<html><body>" + "".join(front) + content + "".join(back) + foot + "</body></html>")
    return out


def fit_pages(sources: list[str], options: Boosting = Boosting()) -> Forest | None:
    """A forest from the pages of a bounded sample that mark up their article; None if there are none."""
    rows, labels = [], []
    for source in taught_pages(sources):
        page = parse(source)
        found = node_features(page)
        label = np.array(page.label)
        for i in range(1, len(label)):
            if label[i] < 0:
                label[i] = label[page.parents[i]]
        rows.append(found)
        labels.append(label == 1)
    if not rows:
        return None
    return fit_forest(np.concatenate(rows), np.concatenate(labels).astype(np.float64), options)


# ---------------------------------------------------------------- choice


def choose(page: Page, odds: np.ndarray, enter: float = 1.0, drop: float = 8.0) -> list[bool]:
    """Which elements' own texts are main text.

    An element is outside, content or dropped. Below content there is content or what is dropped,
    below the dropped nothing else, so that no choice contradicts one above it; the best sum of log odds,
    less the price of each change, decides.
    """
    n = len(page.tags)
    outside, content, dropped = (-odds).tolist(), odds.tolist(), (-odds).tolist()
    for i in range(n - 1, -1, -1):
        if page.dead[i]:
            outside[i], content[i], dropped[i] = 0.0, -math.inf, 0.0
        p = page.parents[i]
        if p >= 0:
            outside[p] += max(outside[i], content[i] - enter)
            content[p] += max(content[i], dropped[i] - drop * (not page.dead[i]))
            dropped[p] += dropped[i]
    state = [0] * n
    for i in range(n):
        p = page.parents[i]
        above = state[p] if p >= 0 else 0
        if above == 0:
            state[i] = int(content[i] - enter > outside[i])
        elif above == 1:
            state[i] = 1 if content[i] >= dropped[i] - drop * (not page.dead[i]) else 2
        else:
            state[i] = 2
    return [s == 1 for s in state]


def blocks_of(page: Page, chosen: list[bool]) -> str:
    """Texts of the chosen elements: white space inside a block is one space, blocks are two line feeds apart."""
    blocks, run = [], []
    for node, text in [*page.parts, (0, None)]:
        if text is None:
            joined = " ".join("".join(run).split())
            if joined:
                blocks.append(joined)
            run = []
        elif chosen[node]:
            run.append(html.unescape(text))
    return "\n\n".join(blocks)


def _rule(x: np.ndarray) -> np.ndarray:
    """Log odds without a model: anything but the parts that markup names."""
    at = len(_TAGS)
    named = x[:, at : at + len(_KINDS) - 1].any(1)
    return np.where(named, -4.0, 1.0)


def extract(sources: list[str | None], forest: Forest | None) -> list[str]:
    """Main text of each page."""
    pages = [parse(s or "") for s in sources]
    found = [node_features(p) for p in pages]
    x = np.concatenate(found)
    odds = np.clip(forest.log_odds(x) if forest else _rule(x), -6, 6)
    out, at = [], 0
    for page, rows in zip(pages, found):
        out.append(blocks_of(page, choose(page, odds[at : at + len(rows)])))
        at += len(rows)
    return out


def _extractor(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches):
            texts = pa.array(extract(part.column("text").to_pylist(), shared.value), pa.string())
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), texts], names=["page_id", "url", "text"])

    return run


def extract_pages(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sample: int = 250
) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.

    The model learns from at most ``sample`` pages, the first by a hash of their id, those that mark
    up an article; all pages are extracted whole. A null or empty page, and one without main text,
    has the empty text. Repeated rows give repeated results, null ids and urls stay null; an empty table
    gives an empty result; other columns are not read.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("text"))
    drawn = rows.filter("length(text) BETWEEN 1 AND 200000").orderBy(F.xxhash64("page_id"), F.xxhash64("text")).limit(sample)
    forest = fit_pages([r["text"] for r in drawn.select("text").collect()])
    shared = pages.sparkSession.sparkContext.broadcast(forest)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    out = rows.mapInArrow(_extractor(shared), f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
