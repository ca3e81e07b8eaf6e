"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page becomes the sequence of its leaf blocks: runs of text between block-level tags. Features are the ancestor tags,
words of their class and id attributes, and the text's length, links and punctuation. Two labels, content or not; the
chain is trained on labelled pages and decoded by Viterbi.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finquarry.llm.common import hashed_sample

# How HTML groups its tags.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style".split())  # end with the page where nothing closes them
HIDDEN = frozenset("noscript template svg iframe textarea select object".split())  # nothing where nothing closes them
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br input label".split())
CLOSED_BY = {"p": frozenset("p div ul ol dl table section article aside header footer nav main form blockquote pre h1 h2 h3 h4 h5 h6 hr figure address fieldset".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
# Parts of class and id words that say what a container is for.
HINTS = ("nav", "menu", "header", "head", "foot", "side", "comment", "reply", "ad", "banner", "sponsor", "promo", "cookie", "notice", "consent", "popup", "modal", "share", "social", "relat", "breadcrumb", "form", "newsletter", "subscri", "search", "login", "tag", "meta", "content", "article", "post", "entry", "story", "body", "main", "text", "page", "widget", "copy")

_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_STOP = re.compile(r">|=\s*([\"'])")
_EDGE = {t: re.compile(rf"<(/?){t}(?=[\s/>])", re.I) for t in RAW | HIDDEN}
#: Elements nested deeper are not kept as ancestors; their text hangs on the last one kept.
DEEPEST = 400
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPLIT = re.compile(r"[^a-z]+")


@dataclass
class Block:
    text: str
    tags: tuple[str, ...]
    hints: frozenset[str]
    linked: int


def _hints(attrs: str) -> frozenset[str]:
    found = set()
    for m in _ATTR.finditer(attrs):
        for word in _SPLIT.split(next(x for x in m.groups() if x is not None).lower() if any(x is not None for x in m.groups()) else ""):
            found.update(h for h in HINTS if (word == h or word in ("ads", "adv", "advert") if h == "ad" else word.startswith(h)))
    return frozenset(found)


class _Scanner:
    """Ends of tags and elements of one page. Each search that fails is not made again, so a page is read in linear time
    however its quotes and tags are broken."""

    def __init__(self, html: str):
        self.html, self.missing = html, set()

    def find(self, s: str, at: int) -> int:
        if s in self.missing:
            return -1
        found = self.html.find(s, at)
        if found < 0:
            self.missing.add(s)
        return found

    def tag_end(self, at: int) -> int:
        """Where the > of the tag that begins before `at` is; quoted values may hold one. Quotes that nothing closes are
        signs like others. -1: no > ends it."""
        if "quotes" in self.missing:
            return self.find(">", at)
        pos = at
        while m := _STOP.search(self.html, pos):
            if not m[1]:
                return m.start()
            close = self.find(m[1], m.end())
            pos = m.end() if close < 0 else close + 1
        self.missing.add("quotes")
        return self.find(">", at)

    def element_end(self, tag: str, at: int) -> int:
        """Where the element that begins before `at` ends, nested ones of its name counted; -1: nothing closes it."""
        if "/" + tag in self.missing:
            return -1
        depth, last = 1, -1
        for m in _EDGE[tag].finditer(self.html, at):
            depth += -1 if m[1] else tag in HIDDEN
            if m[1]:
                last = m.start()
            if not depth:
                break
        if last < 0:
            self.missing.add("/" + tag)
            return -1
        end = self.tag_end(last + 2)
        return len(self.html) if end < 0 else end + 1


def leaf_blocks(html: str) -> list[Block]:
    """Leaf blocks in page order, references decoded and white space made one space. Unclosed and stray tags are borne:
    an open quote, comment or hidden element takes no more with it than its page must lose."""
    blocks: list[Block] = []
    stack: list[tuple[str, frozenset[str]]] = []
    deeper: dict[str, int] = {}
    text: list[str] = []
    linked = at = 0
    scan = _Scanner(html)

    def flush() -> None:
        nonlocal linked
        if text:
            t = " ".join(unescape("".join(text)).split())
            if t:
                blocks.append(Block(t, tuple(x for x, _ in stack if x not in INLINE), frozenset().union(*(h for _, h in stack)), min(linked, len(t))))
            text.clear()
        linked = 0

    def add(s: str) -> None:
        nonlocal linked
        if s:
            text.append(s)
            if any(t == "a" for t, _ in stack[-4:]):
                linked += len(s.strip())

    n = len(html)
    while at < n:
        start = html.find("<", at)
        if start < 0:
            add(html[at:])
            break
        add(html[at:start])
        if html.startswith("<!--", start):
            end = scan.find("-->", start + 4)
            at = n if end < 0 else end + 3
            continue
        m = _NAME.match(html, start)
        end = scan.tag_end(m.end()) if m else scan.find(">", start) if html.startswith(("<!", "<?"), start) else -1
        if end < 0:  # no tag: the sign itself
            add("<")
            at = start + 1
            continue
        at = end + 1
        if not m:
            continue
        tag, closes, attrs = m[1].lower(), html[start + 1] == "/", html[m.end() : end]
        if tag in _EDGE:
            if not closes and not attrs.endswith("/"):
                end = scan.element_end(tag, at)
                at = end if end >= 0 else n if tag in RAW else at
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag not in INLINE:
            flush()
        if closes:
            if deeper.get(tag):
                deeper[tag] -= 1
                continue
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    deeper.clear()
                    break
                if tag in INLINE and stack[i][0] not in INLINE:
                    break
        elif tag not in VOID and not attrs.endswith("/"):
            for i in range(len(stack) - 1, -1, -1):
                if tag in CLOSED_BY.get(stack[i][0], ()):
                    del stack[i:]
                    break
                if stack[i][0] not in INLINE and stack[i][0] not in CLOSED_BY:
                    break
            if len(stack) < DEEPEST:
                stack.append((tag, _hints(attrs) if attrs else frozenset()))
            else:
                deeper[tag] = deeper.get(tag, 0) + 1
    flush()
    return blocks


def _bucket(n: int) -> int:
    return min(10, n.bit_length())


def block_features(b: Block, i: int, n: int) -> list[str]:
    words = b.text.count(" ") + 1
    share = 4 * b.linked // max(1, len(b.text))
    near = [t for t in b.tags if t not in ("html", "body")]
    return [
        "1", *(f"a={t}" for t in set(b.tags)), *(f"h={h}" for h in b.hints), f"leaf={near[-1] if near else '-'}", f"up={near[-2] if len(near) > 1 else '-'}", f"depth={min(6, len(near))}",
        f"chars={_bucket(len(b.text))}", f"words={_bucket(words)}", f"link={share}", f"stop={b.text[-1] in '.!?…:;'}", f"commas={min(3, b.text.count(','))}",
        f"copy={'©' in b.text or '(c)' in b.text.lower()}", f"first={min(i, 3)}", f"last={min(n - 1 - i, 3)}",
    ]


@dataclass
class Crf:
    """Two-label chain: weight (features x 2), move (2 x 2)."""

    index: dict[str, int]
    weight: np.ndarray
    move: np.ndarray

    def emissions(self, blocks: list[Block]) -> np.ndarray:
        at = [[j for f in block_features(b, i, len(blocks)) if (j := self.index.get(f)) is not None] for i, b in enumerate(blocks)]
        return np.array([self.weight[a].sum(axis=0) for a in at])

    def decode(self, blocks: list[Block]) -> list[int]:
        """The most likely labels (Viterbi)."""
        if not blocks:
            return []
        e, ((aa, ab), (ba, bb)) = self.emissions(blocks).tolist(), self.move.tolist()
        x, y, back = *e[0], []
        for p, q in e[1:]:
            fx, fy = y + ba > x + aa, y + bb > x + ab
            back.append((fx, fy))
            x, y = p + (y + ba if fx else x + aa), q + (y + bb if fy else x + ab)
        out = [int(y > x)]
        for step in reversed(back):
            out.append(int(step[out[-1]]))
        return out[::-1]


def fit_crf(pages: list[tuple[list[Block], list[int]]], epochs: int = 80, rate: float = 0.5, l2: float = 1e-4) -> Crf:
    """Maximum likelihood with a penalty, by Adam over all pages at once; expectations by forward-backward."""
    pages = [p for p in pages if p[0]]
    index: dict[str, int] = {}
    most = max((len(b) for b, _ in pages), default=1)
    rows = [[[index.setdefault(f, len(index)) for f in block_features(b, i, len(bs))] for i, b in enumerate(bs)] for bs, _ in pages]
    flat = np.array([j for page in rows for fs in page for j in fs], dtype=np.int64)
    owner = np.repeat(np.arange(sum(map(len, rows))), [len(fs) for page in rows for fs in page])
    page_at = np.array([p for p, page in enumerate(rows) for _ in page], dtype=np.int64)
    time_at = np.array([t for page in rows for t in range(len(page))], dtype=np.int64)
    gold = np.array([y for _, ys in pages for y in ys], dtype=np.int64)
    mask = np.zeros((len(pages), most), dtype=bool)
    mask[page_at, time_at] = True
    y = np.zeros((len(pages), most), dtype=np.int64)
    y[page_at, time_at] = gold
    w, move = np.zeros((len(index), 2)), np.zeros((2, 2))
    seen = np.zeros((2, 2))
    both = mask[:, 1:] & mask[:, :-1] if most > 1 else np.zeros((len(pages), 0), bool)
    np.add.at(seen, (y[:, :-1][both], y[:, 1:][both]), 1)
    m1, m2 = [np.zeros_like(w), np.zeros_like(move)], [np.zeros_like(w), np.zeros_like(move)]
    for epoch in range(1, epochs + 1):
        own = np.zeros((len(gold), 2))
        np.add.at(own, owner, w[flat])
        e = np.zeros((len(pages), most, 2))
        e[page_at, time_at] = own
        fwd, bwd = np.zeros_like(e), np.zeros_like(e)
        fwd[:, 0] = e[:, 0]
        for t in range(1, most):
            new = np.logaddexp.reduce(fwd[:, t - 1, :, None] + move, axis=1) + e[:, t]
            fwd[:, t] = np.where(mask[:, t, None], new, fwd[:, t - 1])
        for t in range(most - 2, -1, -1):
            new = np.logaddexp.reduce(move + (e[:, t + 1] + bwd[:, t + 1])[:, None, :], axis=2)
            bwd[:, t] = np.where(mask[:, t + 1, None], new, 0)
        z = np.logaddexp.reduce(fwd[:, -1], axis=1)
        p = np.exp(fwd + bwd - z[:, None, None])[page_at, time_at]
        err = -p
        err[np.arange(len(gold)), gold] += 1
        gw = np.zeros_like(w)
        np.add.at(gw, flat, err[owner])
        pair = np.exp(fwd[:, :-1, :, None] + move + (e[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None])
        grads = [gw / len(gold) - l2 * w, (seen - pair[both].sum(axis=0)) / len(gold) - l2 * move]
        for k, (x, g) in enumerate(zip((w, move), grads, strict=True)):
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.99 * m2[k] + 0.01 * g * g
            x += rate * (m1[k] / (1 - 0.9**epoch)) / (np.sqrt(m2[k] / (1 - 0.99**epoch)) + 1e-8)
    return Crf(index, w, move)


_NOISE = frozenset("nav header footer aside form dialog menu button title figcaption".split())
_NOISE_HINTS = frozenset("nav menu side comment reply ad banner sponsor promo cookie notice consent popup modal share social relat breadcrumb newsletter subscri search login widget".split())


def labels_by_markup(blocks: list[Block]) -> list[int] | None:
    """Labels of a page whose author marked its article: inside <article> (else <main>) and in no other region."""
    mark = next((t for t in ("article", "main") if any(t in b.tags for b in blocks)), None)
    if mark is None:
        return None

    def inside(b: Block) -> bool:
        return mark in b.tags and not _NOISE & set(b.tags[b.tags.index(mark) :]) and not _NOISE_HINTS & b.hints

    return [int(inside(b)) for b in blocks]


def template_pages(count: int = 200, seed: int = 5) -> list[tuple[list[Block], list[int]]]:
    """Labelled pages out of a small grammar of layouts. A word of the article begins with q, so labels are known."""
    rnd, out = random.Random(seed), []

    def words(lead: str, low: int, high: int) -> str:
        return " ".join(lead + "".join(rnd.choice("abcdeilmnorstu") for _ in range(rnd.randint(1, 7))) for _ in range(rnd.randint(low, high)))

    def sentence(lead: str, low: int = 4, high: int = 30) -> str:
        return words(lead, low, high).capitalize() + rnd.choice([".", ".", ".", "!", "?", "", ","])

    def links(k: int) -> str:
        return "".join(f"<li><a href='/x'>{words('z', 1, 3)}</a></li>" for _ in range(k))

    def some(*makers, keep: float = 0.6) -> str:
        return "".join(m() for m in makers if rnd.random() < keep)

    for _ in range(count):
        kind = rnd.choice(["div", "section"])
        body = "".join(rnd.choice([f"<p>{sentence('q', 1, 60)}</p>", f"<p>{sentence('q', 5, 80)} <a href='/y'>{words('q', 1, 2)}</a> {sentence('q')}<br>{sentence('q')}", f"<h2>{words('q', 1, 6)}</h2>", f"<ul><li>{sentence('q')}</li><li>{words('q', 1, 6)}</li></ul>", f"<blockquote><p>{sentence('q')}</p></blockquote>", f"<p><b>{sentence('q', 5, 60)}<br>"]) for _ in range(rnd.randint(1, 14)))
        inner = f"<h1>{words('q', 2, 12)}</h1>" + body
        wrap = rnd.choice(["article", "article", "main", "div class='content'", "div class='post-body'", "div id='main-text'", "section class='entry'", "div class='story'", "div class='article-body'", "div"])
        ads = lambda: f"<{kind} class='{rnd.choice(['ad', 'ads', 'banner', 'sponsored', 'promo'])}'>{sentence('z')}</{kind}>"
        nav = lambda: rnd.choice([f"<nav><ul>{links(rnd.randint(2, 8))}</ul></nav>", f"<div class='menu'><ul>{links(5)}</ul></div>", f"<ul id='nav'>{links(4)}</ul>", f"<div class='breadcrumb'><a href='/'>{words('z', 1, 1)}</a> / {words('z', 1, 2)}</div>"])
        head = lambda: f"<header><a href='/'>{words('z', 1, 3)}</a><p>{words('z', 1, 6)}</p></header>"
        side = lambda: rnd.choice([f"<aside><h3>{words('z', 1, 3)}</h3><ul>{links(4)}</ul><p>{sentence('z')}</p></aside>", f"<div class='sidebar'><p>{sentence('z')}</p><ul>{links(3)}</ul></div>", f"<div class='related'><h3>{words('z', 1, 3)}</h3><ul>{links(4)}</ul></div>"])
        note = lambda: f"<div class='{rnd.choice(['cookie-notice', 'consent', 'notice', 'popup'])}'><p>{sentence('z')}</p><button>{words('z', 1, 2)}</button></div>"
        form = lambda: f"<form class='{rnd.choice(['newsletter', 'search', 'login'])}'><label>{words('z', 1, 3)}</label><input><p>{sentence('z')}</p><button>{words('z', 1, 1)}</button></form>"
        comment = lambda: f"<{kind} {rnd.choice(['id', 'class'])}='comments'><h3>{words('z', 1, 2)}</h3>" + "".join(f"<div class='comment'><p>{sentence('z', 3, 60)}</p></div>" for _ in range(rnd.randint(1, 5))) + f"</{kind}>"
        foot = lambda: rnd.choice([f"<footer>&copy; {words('z', 1, 3)} &middot; {sentence('z')}</footer>", f"<div class='footer'><p>&copy; {words('z', 1, 3)}</p><ul>{links(3)}</ul></div>"])
        share = lambda: f"<div class='share social'>{words('z', 1, 4)}</div>"
        deep = some(ads, side, share, form, keep=0.15)
        html = f"<html><head><title>{words('z', 2, 8)}</title></head><body>{some(note, head, nav, ads, side)}<{wrap}>{inner}{deep}{some(comment, keep=0.15)}</{wrap.split()[0]}>{some(comment, side, form, ads, foot, note)}{foot()}</body></html>"
        blocks = leaf_blocks(html)
        out.append((blocks, [int(b.text.lower().startswith("q")) for b in blocks]))
    return out


def fit_extractor(pages: DataFrame, most: int = 120, longest: int = 200_000, most_blocks: int = 2000, id_col: str = "page_id", html_col: str = "html") -> Crf:
    """Trained on the grammar's pages and on at most `most` of the table's whose markup shows their article.

    Bounds of the training sample: whole pages of at most `longest` characters and `most_blocks` blocks, those with the
    smallest hashes of their id. Longer pages are extracted like others, but not learnt from.
    """
    marked = pages.filter((F.char_length(html_col) <= longest) & F.col(html_col).rlike("(?i)<(article|main)[\\s>]")).select(F.col(id_col).alias("i"), F.col(html_col).alias("html"))
    own = []
    for r in hashed_sample(marked, "i", most).collect():
        blocks = leaf_blocks(r.html)
        if len(blocks) <= most_blocks and (labels := labels_by_markup(blocks)):
            own.append((blocks, labels))
    return fit_crf(template_pages() + own)


def extract_text(pages: DataFrame, model: Crf, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page: its content blocks joined by line ends.

    Null or empty html, and pages without content: empty text. Whole pages are read; repeated rows give repeated
    results. Elements nested deeper than 400 are no ancestors of their text. A script or style that nothing closes ends
    with the page, as HTML says; other hidden elements that nothing closes hide nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for html in batch.column(2).to_pylist():
                blocks = leaf_blocks(html or "")
                texts.append("\n".join(b.text for b, y in zip(blocks, model.decode(blocks), strict=True) if y))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return src.mapInArrow(run, "page_id long, url string, text string, n_chars long")
