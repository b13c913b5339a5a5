"""Main text of web pages by boosted trees over DOM nodes, decoded along the tree.

A tolerant scanner makes the tree of a page's block elements. Each node has features of its subtree (text, links and
punctuation density, paragraphs), of its attribute tokens, its depth and its siblings. Attribute tokens count by learned
weights of their hashes (the tag, whole words and their pieces of three letters), so words that training never saw weigh
by their pieces. Boosted trees give the odds that a node holds main text. The decoding picks, for each node, the likelier
of dropping its whole subtree and keeping the node with the best choice for each child, so a kept node never hangs under
a dropped one.

Weights and trees are trained here on PAGES pages that a rule writes, with varied layouts, names and known main text.

Null html counts as empty: empty text, 0 characters. A null page_id or url stays. Repeated rows give repeated results,
an empty table gives none. A page without markup is one block. Pages are handled alone, whole, in one pass whose time
grows with their length; only page_id, url and html are read, so further columns don't matter."""

import functools
import html as entities
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm import boosting

PAGES = 600
#: HTML's elements by how they are treated.
_RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "select", "object", "title", "head")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_ENDS_P = _BLOCK - {"option", "caption", "legend", "summary", "tbody", "td", "tfoot", "th", "thead", "tr", "li", "dd", "dt"}
_TAGS = ("article", "main", "section", "div", "p", "h1", "h2", "ul", "li", "nav", "header", "footer", "aside", "form", "table", "td", "blockquote", "pre", "figure", "body")
_BAD_TAGS = frozenset(("nav", "footer", "aside", "form", "header", "menu", "dialog", "fieldset", "search"))
_SECTIONS = _BAD_TAGS | {"article", "main"}
SLOTS, KNOWN = 8192, 1 << 16
_REST = r"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?|"
_END = r"|</?[A-Za-z][^<>]*\Z|[^<]+|<"
#: A tag may hold ">" in quotes. Where a quote or tag stays open to the page's end, the rest of the page is read by _PLAIN.
_TOKEN = re.compile(_REST + r"<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>" + _END, re.S)
_PLAIN = re.compile(_REST + r"<(/?)([A-Za-z][A-Za-z0-9:-]*+)([^<>]*+)>" + _END, re.S)
_OPENED = re.compile(r"</?[A-Za-z]")
#: A name and perhaps its value, as browsers part them; what stands between attributes is skipped.
_ATTRIBUTE = re.compile(r"""(=?[^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?|[\s/>=]""")
_NAMING = ("class", "id", "role", "aria-label", "itemprop")
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "kids", "pieces", "words", "hidden", "order", "chars", "link", "stops", "paragraphs", "count", "heads", "top")

    def __init__(self, tag, parent, words=frozenset(), hidden=False):
        self.tag, self.parent, self.kids, self.pieces, self.words, self.hidden = tag, parent, [], [], words, hidden
        self.chars = self.link = self.stops = self.paragraphs = self.count = self.heads = self.top = 0


def attributes(source: str) -> dict[str, str]:
    """A start tag's attributes, lower-cased, read one after another; the first of equal names counts."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(source):
        if m.group(1):
            found.setdefault(m.group(1).lower(), (m.group(2) or m.group(3) or m.group(4) or "").lower())
    return found


def _styled_away(style: str) -> bool:
    """Whether a style's last word on display is none."""
    shown = [v.replace("!important", "").strip() for k, _, v in (rule.partition(":") for rule in style.split(";")) if k.strip() == "display"]
    return bool(shown) and shown[-1] == "none"


def parse(page: str) -> Node:
    """The tree of block elements. Text runs straight inside a block become leaves (tag "#"), in page order."""
    root = Node("#root", None)
    at, links, run, end, k = root, 0, None, len(page), 0
    find, nested, unclosed = _TOKEN.match, Counter(), set()
    while k < end:
        m = find(page, k)
        if m.end() == k + 1 and m.group() == "<" and find != _PLAIN.match and _OPENED.match(page, k):
            find = _PLAIN.match
            m = find(page, k)
        k = m.end()
        tag = m.group(2)
        if tag is None:
            s = m.group()
            if s[0] == "<" and len(s) > 1:  # a comment, a declaration or a tag that the page's end cuts off
                continue
            if run is None:
                run = Node("#", at)
                at.kids.append(run)
            run.pieces.append((s, links > 0))
            continue
        tag = tag.lower()
        if tag in _RAW:
            if tag == "head" or m.group(1):
                continue
            close = None if tag in unclosed else re.compile(rf"</{tag}\s*>", re.I).search(page, k)
            if close is None:  # none further on either
                unclosed.add(tag)
            k = close.end() if close else (end if tag in ("script", "style", "textarea", "template") else k)
            continue
        if tag == "a":
            links = max(0, links + (-1 if m.group(1) else 1))
            continue
        if tag == "br":
            if run is not None:
                run.pieces.append((" ", False))
            continue
        if tag not in _BLOCK:
            continue
        run = None
        if m.group(1):
            if nested[tag]:
                up = at
                while up.tag != tag:
                    nested[up.tag] -= 1
                    up = up.parent
                nested[tag] -= 1
                at, links = up.parent, 0
            continue
        if tag == "hr":
            continue
        if (at.tag == "p" and tag in _ENDS_P) or (tag in ("li", "td", "th", "tr", "dt", "dd", "option") and at.tag == tag):
            nested[at.tag] -= 1
            at = at.parent
        words, hidden = frozenset(), False
        if m.group(3):
            found = attributes(m.group(3))
            hidden = "hidden" in found or _styled_away(found.get("style", ""))
            words = frozenset(_WORD.findall(" ".join(found.get(name, "") for name in _NAMING)))
        node = Node(tag, at, words, hidden)
        at.kids.append(node)
        nested[tag] += 1
        at = node
    return root


def text_of(leaf: Node) -> str:
    return _SPACE.sub(" ", entities.unescape("".join(s for s, _ in leaf.pieces))).strip()


def nodes_of(root: Node) -> list[Node]:
    """All nodes, a parent before its children, with the sums of their subtrees. No recursion: pages may nest deeply."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        node.order = len(out)
        out.append(node)
        stack += reversed(node.kids)
    for node in reversed(out):
        if node.tag == "#":
            for s, linked in node.pieces:
                n = len(s.strip())
                node.chars += n
                node.link += n * linked
                node.stops += s.count(".") + s.count(",") + s.count("!") + s.count("?")
        node.paragraphs += node.tag == "p"
        node.heads += node.tag in ("h1", "h2", "h3")
        node.count += 1
        if node.parent is not None:
            up = node.parent
            for name in ("chars", "link", "stops", "paragraphs", "count", "heads"):
                setattr(up, name, getattr(up, name) + getattr(node, name))
            up.top = max(up.top, node.chars)
    return out


@functools.lru_cache(KNOWN)
def _slots(word: str) -> tuple[int, ...]:
    """A word's hashes: itself, and its pieces of three letters, ends marked."""
    marked = f"^{word}$"
    return tuple(zlib.crc32(x.encode()) % SLOTS for x in (word, *(marked[i : i + 3] for i in range(len(marked) - 2))))


def _hashes(tag: str, words: frozenset) -> list[int]:
    own = {x for w in words for x in _slots(w)}
    if tag in _SECTIONS:
        own.add(zlib.crc32(f"<{tag}>".encode()) % SLOTS)
    return sorted(own)


class Tokens:
    """The log-odds that a section's tag and attribute words give by themselves: weights of their hashes, over the root of their
    number; 0 where there are none."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.known = weights, {}

    def __call__(self, tag: str, words: frozenset) -> float:
        key = (tag, words)
        score = self.known.get(key)
        if score is None:
            if len(self.known) >= KNOWN:
                self.known.clear()
            own = _hashes(tag, words)
            score = self.known[key] = float(self.weights[own].sum()) / max(1, len(own)) ** 0.5
        return score


def fit_tokens(keys: list[tuple[str, frozenset]], y: np.ndarray, steps: int = 150, decay: float = 1e-3) -> Tokens:
    """Logistic regression over the hashes, by scaled gradient steps; without a constant, so that unknown words weigh nothing."""
    own = [_hashes(*k) for k in keys]
    y, own = y[[len(o) > 0 for o in own]], [o for o in own if o]
    size = np.array([len(o) for o in own])
    row, slot, value = np.repeat(np.arange(len(own)), size), np.concatenate(own), np.repeat(size**-0.5, size)
    w, seen = np.zeros(SLOTS), np.full(SLOTS, 1e-8)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.bincount(row, w[slot] * value, len(own))))
        g = np.bincount(slot, (p - y)[row] * value, SLOTS) / len(own) + decay * w
        seen += g * g
        w -= 0.3 * g / np.sqrt(seen)
    return Tokens(w)


def features(nodes: list[Node], tokens: Tokens) -> np.ndarray:
    total = max(1, nodes[0].chars)
    depth, worst, best, sums, last, rows = {}, {}, {}, {}, {}, []
    named = max((tokens(n.tag, n.words) for n in nodes[1:] if n.tag not in ("#", "body")), default=0.0)
    for node in nodes:
        up = node.parent
        if node.tag == "#" and len(up.kids) == 1:  # a text run alone in its block is judged as the block is
            rows.append(rows[up.order])
            continue
        d = depth[node.order] = depth[up.order] + 1 if up else 0
        own = tokens(node.tag, node.words) if up and node.tag not in ("#", "body") else 0.0  # a body's classes name the page's kind
        lo = worst[node.order] = min(own, worst[up.order]) if up else 0.0
        hi = best[node.order] = max(own, best[up.order]) if up else 0.0
        along = sums[node.order] = own + (sums[up.order] if up else 0.0)
        near = last[node.order] = own or (last[up.order] if up else 0.0)
        kin = up.kids if up else [node]
        chars = max(1, node.chars)
        tag = node.tag if node.tag != "#" else up.tag
        rows.append((
            _TAGS.index(tag) if tag in _TAGS else -1, node.tag == "#", own, lo, hi, along, near, named, node.heads, up.heads if up else 0, node.chars / max(1, up.top) if up else 1.0, len(node.words), d, node.chars, node.chars / total, node.link / chars,
            node.stops / chars, node.paragraphs, node.count, node.chars / node.count, len(kin), up.chars / total if up else 1.0, node.chars / max(1, up.chars) if up else 1.0,
            up.link / max(1, up.chars) if up else 0.0, sum(k.tag == node.tag for k in kin) if len(kin) < 64 else 64,
        ))
    return np.array(rows, np.float64)


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """Which nodes stay: the likeliest choice in which whatever is kept has kept ancestors."""
    keep_cost, drop_cost = np.logaddexp(0, -odds), np.logaddexp(0, odds)
    drop_all, best = drop_cost.copy(), keep_cost.copy()
    for node in reversed(nodes):
        i = node.order
        if node.hidden:
            best[i] = np.inf
        if node.parent is not None:
            drop_all[node.parent.order] += drop_all[i]
            best[node.parent.order] += min(best[i], drop_all[i])
    kept = np.zeros(len(nodes), bool)
    for node in nodes:
        i = node.order
        kept[i] = node.parent is None or (kept[node.parent.order] and best[i] <= drop_all[i])
    return kept


def extract(pages: list[str], model: tuple[Tokens, list]) -> list[str]:
    trees = [nodes_of(parse(p)) for p in pages]
    if not trees:
        return []
    tokens, boosted = model
    odds = np.split(boosting.log_odds(boosted, np.vstack([features(t, tokens) for t in trees])), np.cumsum([len(t) for t in trees])[:-1])
    out = []
    for nodes, o in zip(trees, odds, strict=True):
        kept = decode(nodes, o)
        blocks = (text_of(n) for n in nodes if n.tag == "#" and kept[n.order])
        out.append(" ".join(b for b in blocks if b))
    return out


#: The names that the writer gives to blocks of each kind; any may carry one of the _AROUND before or behind it, or be a word of chance.
_NAMES = {
    "nav": "nav navbar navigation menu menubar topnav toolbar breadcrumb breadcrumbs pagination pager tabs skip", "header": "header head masthead topbar banner branding logo hero",
    "ad": "ad ads advert adverts advertisement promo promotion sponsor sponsored banner", "side": "sidebar side aside rail widget widgets related recommended trending popular",
    "notice": "cookie cookies consent notice notices alert popup modal privacy gdpr", "form": "form forms search login signup subscribe newsletter register",
    "comments": "comment comments reply replies disqus discussion responses thread", "footer": "footer foot bottom copyright legal colophon meta", "share": "share social sharing follow tags",
    "main": "article articles main content contents body story post entry text prose copy page document doc hentry", "around": "wrapper container page site row col column layout outer inner grid content main primary center wrap",
}
_AROUND = "site page top main box wrap wrapper container inner list block area left right js c u item section".split()


def _name(rng: random.Random, kind: str) -> str:
    if rng.random() < (0.3 if kind in ("main", "around") else 0.1):
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8)))
    name, extra, join = rng.choice(_NAMES[kind].split()), rng.choice(_AROUND), rng.choice("-_ ")
    form = rng.random()
    return name if form < 0.5 else f"{name}{join}{extra}" if form < 0.75 else f"{extra}{join}{name}"


def written_page(rng: random.Random) -> str:
    """A page of a random layout. Main text is marked by words starting with "q", all else has none."""
    def prose(main, lo, hi):
        words = ["".join(rng.choice("aeioumnrst") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(lo, hi))]
        words = [("q" + w if main else w) + rng.choice(("", "", "", "", "", ",", ".")) + rng.choice(("", "", "", "", "###", "&amp;") if rng.random() < 0.1 else ("",)) for w in words]
        return " ".join(words) + "."

    def links(n):
        return "".join(f'<li><a href="/{k}">{prose(False, 1, 2)}</a></li>' for k in range(n))

    def wrap(kind, inner, tags):
        tag, name = rng.choice(tags), _name(rng, kind)
        attribute = "" if tag in _BAD_TAGS and rng.random() < 0.7 else f' {rng.choice(("class", "id"))}="{name}"'
        return f"<{tag}{attribute}>{inner}</{tag}>"

    boilerplate = {
        "nav": lambda: wrap("nav", f"<ul>{links(rng.randint(2, 9))}</ul>", ("nav", "div", "nav", "header")) if rng.random() < 0.7 else rng.choice((f"<ul{named(('nav',))}>{links(rng.randint(2, 9))}</ul>", f"<div{named(('nav',))}>" + " ".join(f"<a href=x>{prose(False, 1, 2)}</a>" for _ in range(rng.randint(2, 8))) + "</div>")),
        "header": lambda: wrap("header", rng.choice((f"<h1>{prose(False, 1, 4)}</h1><p>{prose(False, 2, 8)}</p>", f"<a href=x>{prose(False, 1, 4)}</a>", f"<p{named(('header',))}><a href=x>{prose(False, 1, 4)}</a></p>", f"<h1>{prose(False, 1, 3)}</h1>")), ("header", "div")),
        "ad": lambda: wrap("ad", rng.choice(("{}", "<p>{}</p>")).format(prose(False, 3, 40)), ("div", "aside", "section")),
        "side": lambda: wrap("side", f"<h2>{prose(False, 1, 3)}</h2>" + rng.choice((f"<ul>{links(rng.randint(2, 6))}</ul>", f"<p>{prose(False, 10, 40)}</p>")), ("aside", "div")),
        "notice": lambda: wrap("notice", f"<p>{prose(False, 6, 30)}</p><button>ok</button>", ("div", "section")),
        "form": lambda: wrap("form", rng.choice(("{}", "<form>{}</form>")).format(f"<label>{prose(False, 1, 3)}</label><input type=text><p>{prose(False, 3, 10)}</p>"), ("form", "div")),
        "comments": lambda: wrap("comments", rng.choice(("", f"<h2>{prose(False, 1, 3)}</h2>", f"<h3>{prose(False, 1, 3)}</h3>")) + rng.choice(("{}", "<ol>{}</ol>")).format("".join(f"<{t}{named(('comments',), 0.8)}><p>{prose(False, 5, 60)}</p></{t}>" for t in [rng.choice(("div", "li"))] * rng.randint(1, 5))), ("div", "section")),
        "share": lambda: wrap("share", f"<ul>{links(rng.randint(2, 5))}</ul>", ("div", "ul", "section")),
        "footer": lambda: wrap("footer", rng.choice((f"&copy; {prose(False, 3, 20)}", f"<p>{prose(False, 2, 12)}</p>", f"<ul>{links(rng.randint(1, 5))}</ul>")), ("footer", "footer", "div")),
    }

    def paragraph():
        kind = rng.random()
        body = prose(True, 1, 2) if kind < 0.1 else prose(True, 4, 120)
        if kind > 0.9:
            return f"<h2>{prose(True, 1, 5)}</h2>"
        if kind > 0.84:
            tag = rng.choice(("ul", "ol"))
            return f"<{tag}>" + "".join(f"<li>{prose(True, 2, 15)}</li>" for _ in range(rng.randint(2, 7))) + f"</{tag}>"
        if kind > 0.8:
            return rng.choice((f"<blockquote>{body}</blockquote>", f"<dl><dt>{prose(True, 1, 3)}</dt><dd>{prose(True, 3, 20)}</dd></dl>"))
        if kind > 0.77:
            return f"<table><tr><td>{prose(True, 1, 4)}<td>{prose(True, 1, 4)}</table>"
        if kind > 0.74:
            return rng.choice((f"<pre>{body}</pre>", f"<div>{body}</div>", f"<figure><img src=x><figcaption>{prose(True, 2, 12)}</figcaption></figure>", f"<section><h3>{prose(True, 1, 4)}</h3><p>{body}</p></section>"))
        return f"<p>{body}" if kind > 0.7 else f"<p><b>{body}<br>" if kind > 0.6 else f"<p>{body} <a href=x>{prose(True, 1, 3)}</a></p>" if kind > 0.55 else f"<p>{body}</p>"

    def named(kinds, some=1.0):
        """Attributes: one or two of class, id and role, a class of up to three names."""
        if rng.random() > some:
            return ""
        names = " ".join(_name(rng, rng.choice(kinds)) for _ in range(rng.choice((1, 1, 1, 2, 3))))
        return f' class="{names}"' if rng.random() < 0.7 else f' id="{_name(rng, rng.choice(kinds))}"' + f' class="{names}"' * (rng.random() < 0.5)

    def some_of(names, odds):
        return [boilerplate[n]() for n in names if rng.random() < odds]

    title = [f"<{h}{named(('main',), 0.3)}>{prose(True, 1, 10)}</{h}>" for h in ("h1", "h1", "h2")[rng.randrange(3) :][:1]] * (rng.random() < 0.85)
    parts = [paragraph() for _ in range(rng.choice((1, 1, 2, 3, 4, 8, 16)))]
    for name in ("ad", "notice", "form", "side", "share"):
        if rng.random() < 0.12:
            parts.insert(rng.randrange(len(parts) + 1), boilerplate[name]())
    if rng.random() < 0.4:  # the text in a block of its own, under the title
        tag = rng.choice(("div", "div", "section"))
        parts = [f"<{tag}{named(('main',), 0.85)}>{''.join(parts)}</{tag}>"]
    parts = title + parts + (some_of(("share", "form", "side", "comments"), 0.15))
    tag = rng.choice(("article", "article", "article", "main", "div", "div", "section"))
    attribute = " role=main" if rng.random() < 0.05 else named(("main",), 0.95 if tag in ("div", "section") else 0.5)
    inner = f"<{tag}{attribute}>{''.join(parts)}" + f"</{tag}>" * (rng.random() < 0.95)
    if rng.random() < 0.12:  # a table that lays the page out
        beside = rng.choice(("nav", "side", "ad"))
        cells = [f"<td{named((beside,), 0.7)}>{boilerplate[beside]()}</td>", f"<td{named(('main', 'around'), 0.3)}>{rng.choice((inner, ''.join(parts)))}</td>"]
        rows = [f"<tr><td colspan=2>{boilerplate['header']()}</td></tr>"] * (rng.random() < 0.5) + [f"<tr>{''.join(cells if rng.random() < 0.7 else cells[::-1])}</tr>"]
        inner = f"<table>{''.join(rows)}</table>"
    # Blocks around the article, with more and more of the page's other parts in them.
    for _ in range(rng.choice((0, 0, 1, 1, 2, 3))):
        before, after = some_of(("nav", "side", "notice", "ad"), 0.15), some_of(("share", "comments", "side", "ad", "form"), 0.2)
        tag = rng.choice(("div", "div", "div", "main", "section"))
        inner = f"<{tag}{named(('around', 'around', 'main'), 0.9)}>{''.join(before)}{inner}{''.join(after)}</{tag}>"
    before, after = some_of(("header", "nav", "notice", "ad", "side", "form"), 0.4), some_of(("comments", "side", "ad", "form", "notice", "footer"), 0.35)
    rng.shuffle(before)
    inner = "".join(before) + inner + "".join(after)
    if rng.random() < 0.3:
        inner = f'<div{named(("around",))}>{inner}</div>'
    body = named(tuple(_NAMES), 0.3)
    return f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{prose(False, 2, 5)}</title><style>p{{}}</style><script>var t=\"</p>\";</script></head><body{body}>{inner}" + "</body></html>" * (rng.random() < 0.9)


@functools.cache
def fit(pages: int = PAGES, seed: int = 5) -> tuple[Tokens, list]:
    """Token weights and trees from pages written by rule. A node is main if its subtree's text holds marked words.
    Trees learn from token scores by weights of the other half of the pages."""
    rng, written, y = random.Random(seed), [], []
    for _ in range(pages):
        nodes = nodes_of(parse(written_page(rng)))
        written.append(nodes)
        main = np.zeros(len(nodes), bool)
        for node in reversed(nodes):
            if node.tag == "#":
                main[node.order] = bool(re.search(r"\bq", text_of(node)))
            if node.parent is not None and main[node.order]:
                main[node.parent.order] = True
        y.append(main)

    def weights(part):
        pairs = [((n.tag, n.words), y[i][n.order]) for i in part for n in written[i][1:] if n.tag not in ("#", "body")]
        return fit_tokens([k for k, _ in pairs], np.array([m for _, m in pairs], float))

    halves = [weights(range(half, pages, 2)) for half in (1, 0)]
    x = [features(nodes, halves[i % 2]) for i, nodes in enumerate(written)]
    return weights(range(pages)), boosting.fit(np.vstack(x), np.concatenate(y).astype(float), trees=60)


def op3(pages: DataFrame, model: tuple[Tokens, list] | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    model = model or fit()

    def read(batches):
        for batch in batches:
            for lo in range(0, len(batch), 200):
                some = batch.slice(lo, 200)
                texts = extract(some.column(2).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html")).mapInArrow(read, "page_id bigint, url string, text string, n_chars bigint")
