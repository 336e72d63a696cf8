"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

Tasks cut a page into its leaf blocks: runs of text between block-level tags, with the tags, class and id
words of their ancestors. A block is kept or dropped by a chain of two labels whose scores come from
ancestor and text features and from the label before it; the best chain is found by Viterbi.

The field is fitted in the driver, by gradient ascent on the exact log-likelihood (forward-backward), on
labelled pages: at most ``FIT_PAGES`` rows of the table, those with the smallest hash of page_id, whose blocks
inside an article element are labelled as text, and the same blocks laid out anew in other page designs
(main or content divisions, sidebars, notices, forms, comment lists), labelled by construction. The model
is a few thousand weights, whatever the number of pages.

A null or empty page gives an empty text. Character references are decoded, white space in a block becomes
one space, and kept blocks are joined in page order by one space. Nothing is shortened, except that a labelled page
lends its first 14 blocks to each new layout. Text inside svg, math and
object elements is text of the block around them, which the field sees by a feature of its own.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from flowloom.llm.arrow import mapped
from flowloom.llm.language_id import bounded_rows

FIT_PAGES, LAYOUTS, EPOCHS, SEED = 150, 3, 6, 7
#: Elements that begin a block of their own, elements without content, elements of raw text, embedded ones.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol option p pre search section select summary table "
    "tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style noscript template textarea iframe".split()
FOREIGN = frozenset(["svg", "math"])
EMBEDDED = FOREIGN | {"object"}
#: A comment, a section, a declaration, a raw element whole, or the beginning of a tag.
TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    rf"|<({'|'.join(RAW)})\b[^<>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)",
    re.S | re.I,
)
MARK, PLAIN = re.compile("[<>\"']"), re.compile("[^<>]*>")
NAMES = re.compile(r"(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORDS = re.compile(r"[a-z]+")


class Block:
    """A run of text, the block elements around it (each once), the innermost, the words of their names, its marks."""

    __slots__ = ("text", "path", "leaf", "names", "linked", "marks", "embedded")

    def __init__(self, text, path, leaf, names, linked, marks, embedded):
        self.text, self.path, self.leaf, self.names = text, path, leaf, names
        self.linked, self.marks, self.embedded = linked, marks, embedded


class Ends:
    """Where tags end. A quoted value is passed over as a whole, however long; an unclosed quote is an ordinary character."""

    def __init__(self, page: str):
        self.page, self.none_left = page, {'"': len(page) + 1, "'": len(page) + 1}

    def closing(self, quote: str, at: int) -> int:
        """The place of the next quote from at on, or -1."""
        if at >= self.none_left[quote]:
            return -1
        found = self.page.find(quote, at)
        if found < 0:
            self.none_left[quote] = at
        return found

    def of(self, at: int) -> int:
        """The place after the tag whose attributes begin at at, or -1 if it is no tag."""
        pos = at
        while m := MARK.search(self.page, pos):
            c, pos = m[0], m.end()
            if c == ">":
                return pos
            if c == "<":
                break
            close = self.closing(c, pos)
            # a value ends where an attribute may end; else the tag ends at its first >
            if close < 0 or self.page[close + 1 : close + 2] not in tuple(" \t\n\r\f\v/>"):
                break
            pos = close + 1
        plain = PLAIN.match(self.page, at)
        return plain.end() if plain else -1


class Open:
    """The elements that are open, with counts of their tags, names and marks, so that a block costs no walk of them."""

    def __init__(self):
        self.stack, self.tags, self.names, self.marks = [], Counter(), Counter(), Counter()
        self.blocks, self.embedded, self.seen = [], [], None

    def push(self, tag: str, names: list[str], mark: str) -> None:
        if tag in BLOCK:
            self.blocks.append(len(self.stack))
        if tag in EMBEDDED:
            self.embedded.append(len(self.stack))
        self.stack.append((tag, names, mark))
        self.tags[tag] += 1
        self.names.update(names)
        self.marks[mark] += 1
        self.seen = None

    def cut(self, size: int) -> None:
        """Closes all but the first size elements."""
        while len(self.stack) > size:
            tag, names, mark = self.stack.pop()
            for counts, keys in ((self.tags, (tag,)), (self.names, names), (self.marks, (mark,))):
                for k in keys:
                    counts[k] -= 1
                    if not counts[k]:
                        del counts[k]
            for places in (self.blocks, self.embedded):
                if places and places[-1] == len(self.stack):
                    places.pop()
        self.seen = None

    def close(self, tag: str) -> None:
        if self.tags[tag]:
            k = len(self.stack) - 1
            while self.stack[k][0] != tag:
                k -= 1
            self.cut(k)

    def drawing(self) -> bool:
        return any(self.tags[t] for t in FOREIGN)

    def around(self):
        """The block elements, the innermost of them, the names and the marks; shared until an element opens or closes."""
        if self.seen is None:
            leaf = self.stack[self.blocks[-1]][0] if self.blocks else "-"
            self.seen = frozenset(t for t in self.tags if t in BLOCK and self.tags[t]), leaf, frozenset(self.names), frozenset(m for m in self.marks if m)
        return self.seen


def leaf_blocks(page: str) -> list[Block]:
    """The page's runs of text between block-level tags, in page order."""
    blocks, parts, linked, at, embedded = [], [], 0, 0, set()
    ends, now = Ends(page), Open()

    def flush():
        nonlocal parts, linked, embedded
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                path, leaf, names, marks = now.around()
                blocks.append(Block(text, path, leaf, names, linked, marks, embedded))
            parts, linked, embedded = [], 0, set()

    def add(raw):
        nonlocal linked
        if raw:
            text = entities.unescape(raw)
            parts.append(text)
            if now.tags["a"]:
                linked += len(text)
            if now.embedded and text.strip():
                embedded.update(t for t in EMBEDDED if now.tags[t])

    text_from = 0
    while m := TOKEN.search(page, at):
        tag, at = (m[3] or "").lower(), m.end()
        if tag:
            stop = ends.of(at)
            if stop < 0:
                # no tag: its text goes on
                continue
            attrs, at = page[at : stop - 1], stop
        add(page[text_from : m.start()])
        text_from = at
        if not tag:
            if now.drawing():
                # only here a raw element may close itself, and a CDATA section is text
                if m[1] and (own_end := page.index(">", m.start()) + 1) and page[own_end - 2] == "/":
                    at = text_from = own_end
                elif m[0].startswith("<![CDATA["):
                    add(entities.escape(m[0][9:].removesuffix("]]>")))
            continue
        if tag in ("br", "hr"):
            flush()
        if tag in VOID:
            continue
        # the title of a drawing is no block
        block = tag in BLOCK and not (tag == "title" and now.drawing())
        if m[2]:
            if block:
                flush()
            now.close(tag)
            continue
        if block:
            flush()
            # a block inside an embedded element closes none outside of it
            near = now.blocks[-1] if now.blocks else -1
            if near >= 0 and near > (now.embedded[-1] if now.embedded else -1):
                if now.stack[near][0] == "p" or now.stack[near][0] == tag in ("li", "dt", "dd", "option", "tr", "td", "th"):
                    now.cut(near)
        own = WORDS.findall(" ".join(a or b or c for a, b, c in NAMES.findall(attrs)).lower()) if attrs.strip() else []
        mark = ("main" if "data-main" in attrs else "junk" if "data-junk" in attrs else "") if "data-" in attrs else ""
        if not attrs.rstrip().endswith("/"):
            now.push(tag, own, mark)
    add(page[text_from:])
    flush()
    return blocks


def bucket(x: float, edges) -> int:
    return sum(x >= e for e in edges)


def features(blocks: list[Block]) -> list[list[str]]:
    out, n = [], len(blocks)
    for k, b in enumerate(blocks):
        text, size = b.text, len(b.text)
        f = {f"in:{t}" for t in b.path} | {f"name:{w}" for w in b.names} | {f"holds:{t}" for t in b.embedded}
        f.add(f"leaf:{b.leaf}")
        f.add(f"size:{bucket(size, (10, 25, 60, 120, 300))}")
        f.add(f"linked:{bucket(b.linked / size, (0.05, 0.4, 0.9))}")
        f.add(f"stops:{bucket(sum(map(text.count, '.!?,')), (1, 2, 5))}")
        f.add(f"ends:{text[-1] if text[-1] in '.!?:|»' else '-'}")
        f.add(f"place:{bucket(k / n, (0.1, 0.9))}")
        if "©" in text or "@" in text:
            f.add("sign")
        out.append([*f, "all"])
    return out


class Field:
    """Weights of features for the label 1, start scores and transition scores."""

    def __init__(self, weights: dict[str, float], start: np.ndarray, step: np.ndarray):
        self.weights, self.start, self.step = weights, start, step

    def viterbi(self, rows: list[list[str]]) -> list[int]:
        get, (s0, s1), ((a, b), (c, d)) = self.weights.get, self.start, self.step.tolist()
        back, p, q = [], None, None
        for f in rows:
            e = sum([get(x, 0.0) for x in f])
            if p is None:
                p, q = s0, s1 + e
                continue
            back.append((p + a < q + c, p + b < q + d))
            p, q = max(p + a, q + c), max(p + b, q + d) + e
        if p is None:
            return []
        labels = [int(q > p)]
        for to0, to1 in reversed(back):
            labels.append(int(to1 if labels[-1] else to0))
        return labels[::-1]


def fit(pages: list[tuple[list[list[str]], list[int]]], epochs: int = EPOCHS, seed: int = SEED) -> Field:
    """Stochastic gradient ascent on the log-likelihood of label chains."""
    index: dict[str, int] = {}
    data = [([np.array([index.setdefault(x, len(index)) for x in f]) for f in rows], labels) for rows, labels in pages if rows]
    w, start, step = np.zeros(len(index)), np.zeros(2), np.zeros((2, 2))
    order = random.Random(seed)
    for epoch in range(epochs):
        order.shuffle(data)
        rate = 0.3 / (1 + epoch)
        for rows, labels in data:
            n = len(rows)
            e = np.zeros((n, 2))
            e[:, 1] = [w[i].sum() for i in rows]
            ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
            ahead[0] = start + e[0]
            for t in range(1, n):
                ahead[t] = np.logaddexp.reduce(ahead[t - 1][:, None] + step, axis=0) + e[t]
            for t in range(n - 2, -1, -1):
                behind[t] = np.logaddexp.reduce(step + (e[t + 1] + behind[t + 1])[None, :], axis=1)
            total = np.logaddexp.reduce(ahead[-1])
            post = np.exp(ahead + behind - total)
            for t, i in enumerate(rows):
                w[i] += rate * (labels[t] - post[t, 1])
            start[labels[0]] += rate
            start -= rate * post[0]
            for t in range(1, n):
                both = np.exp(ahead[t - 1][:, None] + step + (e[t] + behind[t])[None, :] - total)
                g = -both
                g[labels[t - 1], labels[t]] += 1
                step = step + rate / n * g
        w *= 0.999
    return Field(dict(zip(index, w.tolist())), start, step)


def laid_out(kept: list[str], other: list[str], r: random.Random) -> str:
    """A page of another design with the same blocks; data-main and data-junk mark what is text."""
    esc = entities.escape

    def some(k):
        return [esc(r.choice(other)) for _ in range(r.randint(1, k))] if other else ["-"]

    def sentence():
        words = r.choice(kept).split() if kept else ["-"]
        at = r.randrange(len(words))
        return esc(" ".join(words[at : at + r.randint(3, 30)]))

    def links(tag, cls):
        return f'<{tag} class="{cls}"><ul>' + "".join(f'<li><a href="/x">{" ".join(x.split()[:3])}</a></li>' for x in some(6)) + f"</ul></{tag}>"

    junk = {
        "menu": lambda: links(r.choice(["nav", "div", "header"]), r.choice(["menu", "nav", "navbar", "navigation", "breadcrumb"])),
        "head": lambda: f'<header class="{r.choice(["site-header", "header", "masthead", "top"])}"><{(t := r.choice(["h1", "div", "p"]))}>{sentence()}</{t}></header>',
        "ad": lambda: f'<{(t := r.choice(["div", "aside", "section"]))} class="{r.choice(["ad", "ads", "advert", "banner", "sponsored", "promo", "advertisement"])}">{sentence()}</{t}>',
        "side": lambda: f'<{(t := r.choice(["aside", "div"]))} class="{r.choice(["sidebar", "side", "related", "widget"])}"><h3>{sentence()}</h3><p>{sentence()}</p></{t}>',
        "notice": lambda: f'<div class="{r.choice(["notice", "cookie", "cookie-notice", "alert", "consent", "gdpr", "popup"])}"><p>{sentence()}</p><button>OK</button></div>',
        "form": lambda: f'<form class="{r.choice(["search", "signup", "newsletter", "login"])}"><label>{sentence()}</label><input name="q"><button>{sentence()[:12]}</button><p>{sentence()}</p></form>',
        "comments": lambda: f'<{(t := r.choice(["section", "div", "ol"]))} class="{r.choice(["comments", "comment-list", "discussion", "replies"])}">'
        + "".join(f'<{(u := r.choice(["div", "p", "li", "article"]))} class="{r.choice(["comment", "reply", "user"])}"><p>{sentence()}</p></{u}>' for _ in range(r.randint(1, 4))) + f"</{t}>",
        "foot": lambda: f'<footer class="{r.choice(["footer", "site-footer", "bottom"])}"><p>&copy; {sentence()}</p></footer>',
        "share": lambda: f'<div class="{r.choice(["share", "social", "tags", "meta", "byline"])}">{sentence()[:30]}</div>',
    }

    def put(*kinds, chance=0.5):
        return "".join(f"<div data-junk>{junk[k]()}</div>" if r.random() < 0.2 else junk[k]().replace(">", " data-junk>", 1) for k in kinds if r.random() < chance)

    body = []
    for k, x in enumerate(kept):
        tag = r.choice(["h1", "h2"]) if k == 0 and len(x) < 120 else r.choices(["p", "p", "p", "blockquote", "div", "li", "h2"], [8, 8, 8, 1, 1, 1, 1])[0]
        body.append(f"<{tag}>{esc(x)}</{tag}>" + put("ad", "notice", "form", "share", "side", chance=0.04))
    main = r.choice(['<article{}>{}</article>', '<main{}>{}</main>', '<div class="content"{}>{}</div>', '<div id="main"{}>{}</div>', '<div class="post entry"{}>{}</div>', '<section class="article body"{}>{}</section>', '<main><article{}>{}</article></main>'])
    inside = put("comments", "share", chance=0.3)
    return (
        f"<html><head><title>{sentence()}</title></head><body>" + put("head", "menu", "notice", "ad", "form")
        + main.format(" data-main", "".join(body) + inside) + put("side", "comments", "form", "ad", "foot", "notice", "menu") + "</body></html>"
    )


def labels_of(blocks: list[Block], real: bool) -> list[int]:
    return [int("article" in b.path) if real else int("main" in b.marks and "junk" not in b.marks) for b in blocks]


def fitted(pages: DataFrame, fit_pages: int = FIT_PAGES, seed: int = SEED) -> Field:
    chosen = bounded_rows(pages.where("page_id is not null and html is not null"), fit_pages, "html", key="page_id")
    r, data = random.Random(seed), []
    texts = [x.html for x in chosen if "<article" in x.html] or [
        "<article><h1>A title</h1><p>A first paragraph of text, long enough to read.</p><p>A second one, as long as the first.</p></article><footer>Imprint</footer>"
    ]
    for page in texts:
        blocks = leaf_blocks(page)
        labels = labels_of(blocks, True)
        data.append((features(blocks), labels))
        kept = [b.text for b, y in zip(blocks, labels) if y]
        other = [b.text for b, y in zip(blocks, labels) if not y]
        for _ in range(LAYOUTS):
            new = leaf_blocks(laid_out(kept[:14], other, r))
            data.append((features(new), labels_of(new, False)))
    return fit(data)


def main_text(page: str | None, field: Field) -> str:
    blocks = leaf_blocks(page or "")
    return " ".join(b.text for b, y in zip(blocks, field.viterbi(features(blocks))) if y)


def extract(pages: DataFrame, fit_pages: int = FIT_PAGES) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages."""
    field = fitted(pages, fit_pages)

    def work(batches):
        for batch in batches:
            texts = [main_text(h, field) for h in batch.column("html").to_pylist()]
            yield {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_chars": np.array([len(t) for t in texts], "i8")}

    return mapped(pages.select("page_id", "url", "html"), work, "page_id long, url string, text string, n_chars long")
