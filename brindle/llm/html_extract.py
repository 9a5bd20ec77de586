"""HTML extraction: a linear-chain conditional random field over DOM leaf blocks.

A tolerant parser turns a page into leaf blocks: the text between two block
boundaries, with the open elements around it.  Each block gets features from
its ancestors' tags and class and id words and from its text; a linear-chain
CRF with the labels boilerplate and content, trained on labelled pages, is
decoded by Viterbi.  The main text is the content blocks in page order.

The labelled pages are generated here (``labelled_pages``): layouts that name
their parts in many ways, with the label of each block known by construction.

Parsing takes time in proportion to the page, however deep, long or broken it
is: open elements carry what a block needs of their ancestors, and an end tag
finds its element by a table.  A start tag whose quotes never close is read up
to its first ">"; where that happens LOST_QUOTES times, the rest of the page is
read without regard to quotes.

Null html counts as empty; a page without content blocks has the empty text.
Scripts, styles and comments are never text.  Each input row gives one output
row, repeated rows included; an empty table gives no row, and further columns
play no part, whatever their names.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text

#: Comments, declarations, end tags, start tags (attributes may hold ">" in quotes), broken start tags.
MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|</([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)|<([a-zA-Z][^\s/>]*+)((?>[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|<([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""",
    re.DOTALL,
)
#: A start tag without regard to quotes, and how many start tags with open quotes a page may have until it is used.
PLAIN_TAG, LOST_QUOTES = re.compile(r"<([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)"), 8
NAMES = re.compile(r"""(?:^|[\s"'])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.IGNORECASE)
WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their whole content is no text.
RAW = frozenset("script style title textarea noscript template svg math iframe object select option head".split())
#: Of these a start tag that ends with a slash has no content, unless the slash ends a value without quotes.
FOREIGN = frozenset("svg math path".split())
BARE_VALUE = re.compile(r"""=\s*[^\s"']+\Z""")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: An option outside a select may lack its end tag: it ends at any tag, such as the next option's, that is not inline.
OPTION_END = re.compile(rf"</?(?!(?:{'|'.join(sorted(INLINE))})(?![^\s/>]))[a-z]", re.IGNORECASE)
#: Elements that part a page.
STRUCTURE = frozenset("article main nav aside header footer form section body".split())
#: A start tag of the key closes an open element of the values.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}


@dataclass
class Block:
    text: str
    tags: frozenset[str]  # of all ancestors
    leaf: str  # the innermost ancestor that is not inline
    names: frozenset[str]  # class, id and role words of all ancestors
    inner: tuple[str, frozenset[str]]  # the innermost structural or named element: its tag and words
    links: int  # characters inside links


@dataclass(slots=True)
class Open:
    """An open element, and what a block inside it knows of the ancestors."""

    tag: str
    tags: frozenset[str]
    names: frozenset[str]
    leaf: str
    inner: tuple[str, frozenset[str]]


NONE: frozenset[str] = frozenset()
ROOT = Open("", NONE, NONE, "none", ("none", NONE))


def blocks_of(page: str, known: frozenset[str] | None = None) -> list[Block]:
    """The leaf blocks of a page.  Of the ancestors' tags and words only the known ones are kept, where they are given."""
    out: list[Block] = []
    stack: list[Open] = []
    places: dict[str, list[int]] = {}  # where each tag is open
    boxes: list[int] = []  # where elements that are not inline are open
    parts: list[str] = []
    links = lost = 0
    pos, end = 0, len(page)

    def flush() -> None:
        nonlocal links
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            at = stack[-1] if stack else ROOT
            out.append(Block(text, at.tags, at.leaf, at.names, at.inner, links))
        parts.clear()
        links = 0

    def add(text: str) -> None:
        nonlocal links
        parts.append(text)
        if places.get("a"):
            links += len(text)

    def push(tag: str, names: frozenset[str]) -> None:
        at = stack[-1] if stack else ROOT
        inline = tag in INLINE
        own = names if known is None or not names else names & known
        tags = at.tags if tag in at.tags or (known is not None and tag not in known) else at.tags | {tag}
        inner = (tag, own) if tag in STRUCTURE or (names and not inline) else at.inner
        stack.append(Open(tag, tags, at.names if not own or own <= at.names else at.names | own, at.leaf if inline else tag, inner))
        places.setdefault(tag, []).append(len(stack) - 1)
        if not inline:
            boxes.append(len(stack) - 1)

    def pop() -> None:
        tag = stack.pop().tag
        places[tag].pop()
        if tag not in INLINE:
            boxes.pop()

    while pos < end:
        at = page.find("<", pos)
        if at < 0:
            at = end
        if at > pos:
            add(page[pos:at])
        m = MARKUP.match(page, at) if at < end else None
        if m is not None and (m[2] or m[4]) and lost >= LOST_QUOTES:
            m = PLAIN_TAG.match(page, at)
            tag, attrs = m[1].lower(), m[2]
        elif m is not None:
            lost += m[4] is not None
            tag, attrs = (m[2] or m[4] or "").lower(), m[3] if m[2] else m[5]
        if m is None:
            if at < end:  # a "<" that opens nothing is text
                add("<")
            pos = at + 1
            continue
        pos = m.end()
        if m.re is MARKUP and m[1]:
            tag = m[1].lower()
            if tag not in INLINE:
                flush()
            if (own := places.get(tag)) and (tag not in INLINE or not boxes or own[-1] > boxes[-1]):
                for _ in range(len(stack) - own[-1]):
                    pop()
            continue
        if not tag:
            continue
        if tag not in INLINE:
            flush()
            while stack and stack[-1].tag in INLINE and places.get("p"):
                pop()
            if stack and stack[-1].tag == "p" and tag != "br":
                pop()
            for own in CLOSES.get(tag, ()):
                if stack and stack[-1].tag == own:
                    pop()
        if tag in VOID:
            continue
        if tag in FOREIGN and attrs.endswith("/") and not BARE_VALUE.search(attrs):
            continue
        if tag in RAW and tag != "head":
            close = (OPTION_END if tag == "option" else re.compile(f"</{tag}", re.IGNORECASE)).search(page, pos)
            pos = close.start() if close else end
            if tag == "option":
                continue
        push(tag, frozenset(w.lower() for v in NAMES.findall(attrs) for w in WORDS.findall("".join(v))) if attrs else NONE)
    flush()
    return out


def features(blocks: list[Block]) -> list[list[str]]:
    """The features of each block, from its ancestors and its text."""
    out = []
    for b in blocks:
        n = len(b.text)
        words = b.text.count(" ") + 1
        own = {f"t:{t}" for t in b.tags} | {f"c:{w}" for w in b.names}
        own |= {f"leaf:{b.leaf}", f"len:{min(n.bit_length(), 10)}", f"links:{4 * b.links // n if n else 0}"}
        if words > 8 and b.text[-1] in ".!?…»\"":
            own.add("sentence")
        if "©" in b.text or "copyright" in b.text.lower():
            own.add("copyright")
        inside = "article" in b.tags or "main" in b.tags
        own |= {f"inner:{b.inner[0]}", f"inside:{inside}", f"inner:{b.inner[0]}:{inside}"} | {f"own:{w}" for w in b.inner[1]}
        out.append(sorted(own))
    return out


# Labelled pages -------------------------------------------------------------

#: Names that sites give to the parts around the text.
ASIDE_NAMES = {
    "nav": "nav navbar menu main-menu navigation breadcrumb breadcrumbs topbar pagination pager tabs toc".split(),
    "header": "header site-header masthead banner top branding page-header logo".split(),
    "footer": "footer site-footer page-footer bottom colophon copyright legal".split(),
    "aside": "sidebar side aside widget related recommended trending popular promo teaser rail".split(),
    "div": "ad ads advert advertisement sponsor sponsored banner-ad adslot dfp cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup share social sharing tags meta paywall toolbar widget related promo disclaimer search login".split(),
    "section": "comments comment comment-list replies discussion respond disqus reader-comments feedback related newsletter".split(),
    "form": "search login subscribe contact form newsletter comment-form signup".split(),
    "ul": "menu nav links social share tags pagination breadcrumb comments".split(),
}
MAIN_NAMES = "content article post entry body story main text article-body post-content entry-content main-content page page-content prose copy".split()


def words_of(rng: random.Random, n: int) -> str:
    """Invented words; the CRF must not learn a language."""
    syllables = ["an", "be", "co", "di", "er", "fu", "gha", "in", "jo", "ka", "le", "mo", "na", "or", "pa", "qui", "re", "st", "ti", "un", "vé", "wö", "ção", "zä"]
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(n))


def labelled_pages(n: int = 900, seed: int = 11) -> list[tuple[list[Block], list[int]]]:
    """Blocks of generated pages and their labels (1: content)."""
    return [parsed for k in range(n) if (parsed := labelled(random.Random(seed * 1_000_003 + k)))[0]]


def labelled(rng: random.Random) -> tuple[list[Block], list[int]]:
    """One page; content words carry a mark, which is taken off again once the blocks are known."""
    mark = "⁣"
    text = lambda lo, hi, own="": own + words_of(rng, rng.randint(lo, hi)).capitalize() + rng.choice([".", ".", ".", "", "!", "?"])

    def named(tag: str, names: list[str], inner: str) -> str:
        kind = rng.random()
        attr = f' {rng.choice(["class", "class", "id", "role"])}="{rng.choice(names)}"' if kind < 0.7 else ""
        return f"<{tag}{attr}>{inner}</{tag}>"

    def links(lo: int, hi: int) -> str:
        items = [f'<a href="/{k}">{words_of(rng, rng.randint(1, 4))}</a>' for k in range(rng.randint(lo, hi))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if rng.random() < 0.6 else " | ".join(items)

    def aside(tag: str) -> str:
        inner = rng.choice([links(2, 8), f"<p>{text(2, 40)}</p>", f"<h3>{text(1, 4)}</h3>{links(2, 6)}", text(1, 30), f"<div>{text(3, 60)}</div>", f"<p>{text(8, 60)}</p><p>{text(8, 50)}</p>", f"<h2>{text(1, 3)}</h2><p>{text(1, 9)}</p><p>{text(4, 50)}</p>"])
        if tag == "form":
            inner = f"<label>{text(1, 3)}</label><input><button>{text(1, 2)}</button>"
        if tag == "footer":
            inner = rng.choice([f"&copy; {text(2, 9)}", f"<p>© {text(3, 20)}</p>{links(1, 5)}", text(3, 40), f"<p>{text(8, 40)}</p>"])
        if tag in ("div", "ul", "section"):  # only their names tell
            kind = rng.choice([*ASIDE_NAMES]) if tag == "div" and rng.random() < 0.5 else tag
            return f'<{tag} {rng.choice(["class", "id"])}="{rng.choice(ASIDE_NAMES[kind])}">{inner}</{tag}>'
        return named(tag, ASIDE_NAMES[tag], inner)

    def piece() -> str:
        kind = rng.random()
        if kind < 0.62:
            p = text(1, 120, mark)
            p = f"<b>{p}" if rng.random() < 0.1 else p.replace(" ", " <em>x</em> ", 1) if rng.random() < 0.15 else p.replace(" ", ' <a href="/">y</a> ', 1) if rng.random() < 0.15 else p
            return f"<p>{p}" + rng.choice(["</p>", "</p>", "</p>", "<br>", ""])
        if kind < 0.7:
            return f"<h2>{text(1, 8, mark)}</h2>"
        if kind < 0.77:
            return "<ul>" + "".join(f"<li>{text(1, 25, mark)}</li>" for _ in range(rng.randint(1, 5))) + "</ul>"
        if kind < 0.81:
            return f"<blockquote><p>{text(3, 40, mark)}</p></blockquote>"
        if kind < 0.84:
            return "<table>" + "".join(f"<tr><td>{text(1, 4, mark)}</td><td>{text(1, 4, mark)}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>"
        if kind < 0.86:
            return f"<figure><figcaption>{text(2, 15, mark)}</figcaption></figure>"
        if kind < 0.88:
            return f"<pre><code>{text(2, 30, mark)}</code></pre>"
        if kind < 0.9:
            return f'<p class="{rng.choice(ASIDE_NAMES["div"])}">{text(2, 20)}</p>'
        return aside(rng.choice(["div", "aside", "form", "section", "footer", "nav"]))

    body = [f"<p>{text(1, 90, mark)}</p>"] if rng.random() < 0.15 else [piece() for _ in range(rng.randint(1, 14))]
    if rng.random() < 0.7:
        body.insert(0, f"<h1>{text(2, 10, mark)}</h1>")
        if rng.random() < 0.2:
            body[0] = f"<header>{body[0]}</header>"
    inner = "".join(body)
    frame = rng.random()
    if rng.random() < 0.25 and frame < 0.75:  # a named box inside the article or main part, which may hold others beside it
        inner = f'<div class="{rng.choice(MAIN_NAMES)}">{inner}</div>' + (aside("div") if rng.random() < 0.6 else "")
    if frame < 0.45:
        inner = named("article", MAIN_NAMES, inner)
    elif frame < 0.6:
        inner = named("main", MAIN_NAMES, inner)
    elif frame < 0.75:
        inner = f"<main>{named('article', MAIN_NAMES, inner)}</main>"
    elif frame < 0.87:
        inner = f'<div {rng.choice(["class", "id"])}="{rng.choice(MAIN_NAMES)}">{inner}</div>'
    elif frame < 0.93:
        inner = f'<section class="{rng.choice(MAIN_NAMES)}">{inner}</section>'
    elif frame < 0.97:  # a page laid out as a table
        cells = [f"<td>{links(2, 8)}</td>", f"<td>{inner}</td>", *([f"<td>{links(1, 6)}</td>"] if rng.random() < 0.4 else [])]
        inner = f"<table><tr>{''.join(cells)}</tr></table>"
    before = [aside(t) for t in rng.sample(["nav", "header", "div", "form", "ul", "nav", "div"], rng.randint(0, 4))]
    after = [aside(t) for t in rng.sample(["aside", "div", "section", "footer", "nav", "form", "section"], rng.randint(0, 4))]
    if rng.random() < 0.6:
        after.append(aside("footer"))
    if rng.random() < 0.3:
        after.insert(0, f'<{(t := rng.choice(["div", "section", "ol"]))} class="comments">' + "".join(f'<{(u := rng.choice(["p", "div", "article", "li"]))} class="comment">{text(3, 70)}</{u}>' for _ in range(rng.randint(1, 5))) + f"</{t}>")
    page = f"<html><head><title>{text(1, 5)}</title><style>p{{}}</style></head><body>{''.join(before)}{inner}{''.join(after)}</body></html>"
    blocks = blocks_of(page)
    labels = [int(mark in b.text) for b in blocks]
    for b in blocks:
        b.text = b.text.replace(mark, "") or "x"
    return blocks, labels


# The field --------------------------------------------------------------------


@dataclass
class Field:
    """Weights of the label content against boilerplate, and label-to-label weights."""

    weights: dict[str, float]
    bias: float
    moves: list[list[float]]

    @property
    def known(self) -> frozenset[str]:
        """The tags and words that some weight is about; others change nothing."""
        return frozenset(f.partition(":")[2] for f in self.weights if f.startswith(("t:", "c:", "own:"))) | {"article", "main"}

    def unary(self, own: list[list[str]]) -> list[float]:
        w, b = self.weights, self.bias
        return [b + sum([w.get(f, 0.0) for f in fs]) for fs in own]

    def decode(self, own: list[list[str]]) -> list[int]:
        """Viterbi: the most likely label sequence."""
        if not own:
            return []
        m, back = self.moves, []
        z = self.unary(own)
        s0, s1 = 0.0, z[0]
        for u in z[1:]:
            a, b, c, d = s0 + m[0][0], s1 + m[1][0], s0 + m[0][1], s1 + m[1][1]
            back.append((int(b > a), int(d > c)))
            s0, s1 = max(a, b), max(c, d) + u
        y = [int(s1 > s0)]
        for step in reversed(back):
            y.append(step[y[-1]])
        return y[::-1]


def train(pages: list[tuple[list[Block], list[int]]], rounds: int = 220, rate: float = 0.1, decay: float = 1e-4) -> Field:
    """Maximum likelihood by forward-backward over all pages at once, with Adam."""
    own = [features(b) for b, _ in pages]
    seen: dict[str, int] = {}
    for fs in own:
        for f in (f for block in fs for f in block):
            seen.setdefault(f, len(seen))
    n, t = len(pages), max(len(b) for b, _ in pages)
    y, live = np.zeros((n, t), int), np.zeros((n, t), bool)
    row, col = [], []
    for i, (fs, (_, labels)) in enumerate(zip(own, pages, strict=True)):
        y[i, : len(labels)], live[i, : len(labels)] = labels, True
        for j, block in enumerate(fs):
            row += [i * t + j] * len(block)
            col += [seen[f] for f in block]
    row, col = np.array(row), np.array(col)
    k = len(seen)
    w, m, s = (np.zeros(k + 5) for _ in range(3))  # features, bias, 2 x 2 moves
    both = live[:, 1:] & live[:, :-1]
    move_seen = np.array([[(both & (y[:, :-1] == a) & (y[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)], float)
    log = np.logaddexp
    for step in range(1, rounds + 1):
        u = np.zeros((n, t, 2))
        u[:, :, 1] = (np.bincount(row, w[col], n * t) + w[k]).reshape(n, t)
        mv = w[k + 1 :].reshape(2, 2)
        f, b = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        f[:, 0] = u[:, 0]
        for j in range(1, t):
            for a in (0, 1):
                f[:, j, a] = u[:, j, a] + log(f[:, j - 1, 0] + mv[0, a], f[:, j - 1, 1] + mv[1, a])
        for j in range(t - 2, -1, -1):
            for a in (0, 1):
                b[:, j, a] = np.where(live[:, j + 1], log(u[:, j + 1, 0] + b[:, j + 1, 0] + mv[a, 0], u[:, j + 1, 1] + b[:, j + 1, 1] + mv[a, 1]), 0)
        z = log(f[:, 0, 0] + b[:, 0, 0], f[:, 0, 1] + b[:, 0, 1])
        p1 = np.where(live, np.exp(f[:, :, 1] + b[:, :, 1] - z[:, None]), 0)
        d = np.where(live, p1 - y, 0).ravel()
        pair = [[np.exp(f[:, :-1, a] + mv[a, c] + u[:, 1:, c] + b[:, 1:, c] - z[:, None])[both].sum() for c in (0, 1)] for a in (0, 1)]
        g = np.concatenate([np.bincount(col, d[row], k), [d.sum()], (np.array(pair) - move_seen).ravel()]) / n + decay * w
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return Field({f: float(w[i]) for f, i in seen.items()}, float(w[k]), w[k + 1 :].reshape(2, 2).tolist())


@lru_cache(maxsize=1)
def default_field() -> Field:
    """The field trained on the generated pages, once in a process."""
    return train(labelled_pages())


def main_text(page: str, field: Field, known: frozenset[str] | None = None) -> str:
    blocks = blocks_of(page, known or field.known)
    labels = field.decode(features(blocks))
    return " ".join(b.text for b, y in zip(blocks, labels, strict=True) if y)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", field: Field | None = None) -> DataFrame:
    """(id, main): the main text of every row of pages."""
    field = field or default_field()
    known = field.known
    rows = id_and_text(pages, id_col, html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([main_text(t.as_py(), field, known) for t in b.column(1)], pa.string())], names=["id", "main"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, main string")


def op2_main_text(pages: DataFrame) -> DataFrame:
    """The url travels with the id, so no join is needed."""
    keyed = pages.select(F.struct("page_id", "url").alias("key"), "html")
    return extract(keyed, "key").select("id.page_id", "id.url", F.col("main").alias("text"), F.length("main").cast("long").alias("n_chars"))
