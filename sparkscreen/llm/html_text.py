"""HTML extraction: a linear-chain conditional random field over the leaf blocks of a page.

A page becomes a sequence of leaf blocks, each with the tags and attribute words of its ancestors
and features of its text. The field labels each block as main text or not; its weights are trained
by stochastic gradient on labelled pages and a page is decoded by Viterbi.

Labelled pages are of two kinds, both bounded: (1) a sample of pages of the table that mark their
article (``article``, ``main``): blocks inside are main text but for those under navigation and the
like, and a copy of each page is trained without those marks, so that the field also learns from
the rest; (2) layouts written here with their roles, filled with blocks of the sampled pages, for
parts that a table may not show (comments, notices, sidebars, forms).
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty

#: Bound of what is learnt from the table.
FIT_PAGES, EPOCHS, RATE, DECAY = 300, 6, 0.3, 1e-4

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|([^<]+|<)", re.S)
_ATTR = re.compile(r"\b(?:class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_RAW = {t: re.compile(rf"</{t}\b", re.I) for t in ("script", "style", "textarea", "title", "iframe", "noscript", "template", "svg", "select")}
_IN_HEAD = frozenset("base basefont bgsound link meta noscript script style template title head".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
_ENDS_P = frozenset("address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section summary table ul".split())
_OWN_KIND = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = frozenset("ul ol dl table article section div body nav aside main footer header form".split())
_MARKED, _APART = frozenset(("article", "main")), frozenset(("nav", "aside", "footer", "header", "form", "button"))
_ASIDE_WORDS = frozenset("ad ads advert advertisement banner breadcrumb breadcrumbs comment comments consent cookie copyright disclaimer disqus footer form header login masthead menu nav navbar navigation newsletter notice pager pagination popup promo promoted recommended related reply respond share sharing sidebar signup social sponsor sponsored subscribe tags toolbar widget".split())


class Node:
    """An open element. What its descendants inherit is kept once and shared: a chain of elements that adds nothing costs no more than its links."""

    __slots__ = ("tag", "words", "inherited", "unmarked", "tags", "linked", "inside", "apart")

    def __init__(self, tag: str, words: tuple[str, ...], above: Node | None):
        self.tag, self.words = tag, words
        own = ["in:" + tag, *("word:" + w for w in words), *["aside-word"] * (not _ASIDE_WORDS.isdisjoint(words))]
        self.inherited = self._with(above.inherited if above else frozenset(), own)
        self.unmarked = self._with(above.unmarked if above else frozenset(), own[tag in _MARKED :])
        outer = above.tags if above else ()
        self.tags = outer if tag in _INLINE else (*outer, tag)[-3:]  # three: one of the last two may be a mark
        self.linked = tag == "a" or above is not None and above.linked
        self.inside = tag in _MARKED or above is not None and above.inside
        self.apart = above is not None and above.apart or self.inside and (tag in _APART or not _ASIDE_WORDS.isdisjoint(words))

    @staticmethod
    def _with(all_above: frozenset, own: list[str]) -> frozenset:
        return all_above if all_above.issuperset(own) else all_above.union(own)


@dataclass
class Block:
    text: str
    node: Node | None
    links: int = 0


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order: character references decoded, white space runs made one space."""
    out: list[Block] = []
    stack: list[tuple[str, Node]] = []
    opened: dict[str, int] = defaultdict(int)
    held: list[tuple[str, bool]] = []
    at = 0

    def flush():
        if held:
            text = " ".join("".join(t for t, _ in held).split())
            if text and not opened["head"]:
                out.append(Block(text, stack[-1][1] if stack else None, sum(len(t.strip()) for t, linked in held if linked)))
            held.clear()

    def close(to: int):
        if any(t not in _INLINE for t, _ in stack[to:]):
            flush()
        for t, _ in stack[to:]:
            opened[t] -= 1
        del stack[to:]

    while (m := _TOKEN.match(page, at)) is not None:
        at = m.end()
        raw, name = m[4], m[2]
        if raw is not None:
            if stack and stack[-1][0] == "head" and not raw.isspace():
                close(len(stack) - 1)
            held.append((html.unescape(raw), bool(stack) and stack[-1][1].linked))
            continue
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if opened[name]:
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
            continue
        # a head whose end tag is left out ends at the first thing that may not stand in it
        if stack and stack[-1][0] == "head":
            if name not in _IN_HEAD:
                close(len(stack) - 1)
            elif name == "head":
                continue
        if name in _RAW:
            if not m[0].endswith("/>"):
                end = _RAW[name].search(page, at)
                at = end.start() if end else len(page)
                gone = page.find(">", at)
                at = len(page) if gone < 0 or not end else gone + 1
            continue
        if name in _ENDS_P and opened["p"]:
            to = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "p" or stack[i][0] in _SCOPES), None)
            if to is not None and stack[to][0] == "p":
                close(to)
        if name in _OWN_KIND and any(opened[t] for t in _OWN_KIND[name]):
            to = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in _OWN_KIND[name] or stack[i][0] in _SCOPES), None)
            if to is not None and stack[to][0] in _OWN_KIND[name]:
                close(to)
        if name == "br":
            held.append((" ", False))
        elif name in _VOID:
            if name == "hr":
                flush()
        else:
            if name not in _INLINE:
                flush()
            words = tuple(w for a in _ATTR.findall(m[3]) for w in _WORDS.findall(_CAMEL.sub(" ", "".join(a)).lower())) if m[3] else ()
            if not m[0].endswith("/>"):
                stack.append((name, Node(name, words, stack[-1][1] if stack else None)))
                opened[name] += 1
    flush()
    return out


def features(page_blocks: list[Block], marks: bool = True) -> list[list[str]]:
    out, n = [], len(page_blocks)
    for i, b in enumerate(page_blocks):
        node = b.node
        f = ["bias", *sorted((node.inherited if marks else node.unmarked) if node else ("bare",))]
        tags = [t for t in node.tags if marks or t not in _MARKED] if node else []
        f.append("leaf:" + (tags[-1] if tags else ""))
        f.append("under:" + ">".join(tags[-2:]))
        text = b.text
        words = text.count(" ") + 1
        f += [f"words:{min(8, int(math.log2(words)))}", f"links:{min(4, 4 * b.links // max(1, len(text)))}", f"end:{text[-1] if text[-1] in '.!?:;,' else 'x'}", f"commas:{min(3, text.count(','))}", f"stops:{min(3, text.count('. '))}", f"at:{10 * i // n}"]
        if "©" in text[:20] or "(c)" in text[:20].lower():
            f.append("copyright")
        if i == 0:
            f.append("first")
        if i == n - 1:
            f.append("last")
        out.append(list(dict.fromkeys(f)))
    return out


@dataclass
class Field:
    """Weights for label 1 against 0, and of the four transitions."""

    unary: dict[str, float] = field(default_factory=dict)
    steps: list[list[float]] = field(default_factory=lambda: [[0.0, 0.0], [0.0, 0.0]])

    def scores(self, seq: list[list[str]]) -> list[float]:
        u = self.unary
        return [sum([u.get(x, 0.0) for x in f]) for f in seq]

    def decode(self, seq: list[list[str]]) -> list[int]:
        """Viterbi."""
        if not seq:
            return []
        (t00, t01), (t10, t11) = self.steps
        a, b, back = 0.0, 0.0, []
        for i, s in enumerate(self.scores(seq)):
            if i == 0:
                a, b = 0.0, s
                continue
            from0, from1 = (0, a + t00) if a + t00 >= b + t10 else (1, b + t10), (0, a + t01) if a + t01 >= b + t11 else (1, b + t11)
            back.append((from0[0], from1[0]))
            a, b = from0[1], from1[1] + s
        label = int(b > a)
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]

    def gradient(self, seq: list[list[str]], labels: list[int]) -> tuple[list[float], np.ndarray]:
        """Observed less expected: for each block, and for each transition."""
        n, t = len(seq), np.array(self.steps)
        s = np.zeros((n, 2))
        s[:, 1] = self.scores(seq)
        fwd, bwd = np.zeros((n, 2)), np.zeros((n, 2))
        fwd[0] = s[0]
        for i in range(1, n):
            fwd[i] = s[i] + np.logaddexp(fwd[i - 1][0] + t[0], fwd[i - 1][1] + t[1])
        for i in range(n - 2, -1, -1):
            bwd[i] = np.logaddexp(t[:, 0] + s[i + 1][0] + bwd[i + 1][0], t[:, 1] + s[i + 1][1] + bwd[i + 1][1])
        z = np.logaddexp(*fwd[-1])
        unary = [y - p for y, p in zip(labels, np.exp(fwd[:, 1] + bwd[:, 1] - z).tolist())]
        steps = np.zeros((2, 2))
        for i in range(1, n):
            steps[labels[i - 1], labels[i]] += 1
            steps -= np.exp(fwd[i - 1][:, None] + t + (s[i] + bwd[i])[None, :] - z)
        return unary, steps

    def train(self, pages: list[tuple[list[list[str]], list[int]]], epochs: int = EPOCHS, rate: float = RATE) -> Field:
        squares: dict[str, float] = defaultdict(lambda: 1e-2)
        order = np.random.default_rng(5)
        t, t2 = np.array(self.steps), np.full((2, 2), 1e-2)
        for _ in range(epochs):
            for k in order.permutation(len(pages)):
                seq, labels = pages[k]
                if not seq:
                    continue
                unary, steps = self.gradient(seq, labels)
                total: dict[str, float] = defaultdict(float)
                for f, g in zip(seq, unary):
                    for x in f:
                        total[x] += g
                for x, g in total.items():
                    g -= DECAY * self.unary.get(x, 0.0)
                    squares[x] += g * g
                    self.unary[x] = self.unary.get(x, 0.0) + rate * g / math.sqrt(squares[x])
                t2 += steps**2
                t += rate * steps / np.sqrt(t2)
                self.steps = t.tolist()
        return self


def marked_labels(page_blocks: list[Block]) -> list[int] | None:
    """Labels of a page that marks its article; None if it does not."""
    if not any(b.node and b.node.inside for b in page_blocks):
        return None
    return [int(b.node is not None and b.node.inside and not b.node.apart) for b in page_blocks]


#: Layouts with their roles: {m} stands for main text and {o} for other text of the sampled pages.
LAYOUTS = (
    '<body><header class="site-header"><div id="logo">{o}</div><ul class="menu"><li><a>{s}</a></li><li><a>{s}</a></li></ul></header><div class="cookie-notice"><p>{o}</p><button>{s}</button></div><div id="content"><h1>{t}</h1><p>{m}</p><p>{m}</p><h2>{t}</h2><p>{m}</p></div><div id="comments"><h3>{s}</h3><div class="comment"><p>{o}</p></div><div class="comment"><p>{o}</p></div></div><div class="footer">{o}</div></body>',
    '<body><div class="nav"><a>{s}</a> <a>{s}</a></div><div class="wrapper"><div class="post"><h1>{t}</h1><div class="post-body">{m}<p>{m}</p><ul><li>{m}</li><li>{m}</li></ul><blockquote>{m}</blockquote></div></div><div class="sidebar"><div class="widget"><h3>{s}</h3><ul><li><a>{s}</a></li><li><a>{s}</a></li></ul></div><div class="advert">{o}</div></div></div><footer><p>{o}</p></footer></body>',
    '<body><nav><ul><li><a>{s}</a></li></ul></nav><main><article><h1>{t}</h1><p>{m}</p><div class="ad"><p>{o}</p></div><p>{m}</p><form><label>{s}</label><button>{s}</button></form><p>{m}</p></article><section class="related"><h2>{s}</h2><ul><li><a>{o}</a></li></ul></section><section id="comments"><p>{o}</p><p>{o}</p></section></main><aside><p>{o}</p></aside><footer>{o}</footer></body>',
    '<body><table><tr><td class="menu"><a>{s}</a><br><a>{s}</a></td><td><h2>{t}</h2><p>{m}</p><p>{m}</p><pre>{m}</pre></td></tr></table><div class="newsletter"><form><p>{o}</p></form></div><div class="banner">{o}</div><small>{o}</small></body>',
    "{m}",
    "<h1>{t}</h1><p>{m}</p><p>{m}</p>",
    "<h1>{t}</h1><p>{m}</p><ul><li>{t}</li><li>{t}</li></ul>",
    "<body><h2>{t}</h2>{m}<br><br><p>{m}</p><ul><li>{m}</li><li>{m}</li></ul><p>{m}</p></body>",
    '<body><ul class="topbar"><li><a>{s}</a></li><li><a>{s}</a></li></ul><section class="body"><h1>{t}</h1><p>{m}</p><div>{m}</div><ol><li>{m}</li><li>{m}</li><li>{m}</li></ol><table><tr><th>{t}</th><th>{t}</th></tr><tr><td>{m}</td><td>{m}</td></tr></table><p>{m}</p></section><div class="reviews"><div class="comment"><b>{s}</b><div>{o}</div></div></div><div class="copyright">{o}</div></body>',
)


def layout_pages(sample: list[tuple[list[Block], list[int]]], each: int, seed: int = 3) -> list[tuple[list[Block], list[int]]]:
    """``each`` pages of every layout, filled with blocks of the sampled pages."""
    main = [b.text for p, y in sample for b, l in zip(p, y) if l] or ["Some words of a text, and some more."]
    other = [b.text for p, y in sample for b, l in zip(p, y) if not l] or ["Other words."]
    draw, out = np.random.default_rng(seed), []
    mark = re.compile(r"\{([mots])\}")
    for layout in LAYOUTS:
        for _ in range(each):
            labels: list[int] = []

            def fill(m, labels=labels):
                pool = other if m[1] in "os" else main
                words = pool[draw.integers(len(pool))].split()
                if m[1] == "o" and draw.random() < 0.5:  # other parts also hold running text
                    words = main[draw.integers(len(main))].split()
                words = words[: int(draw.integers(1, 5))] if m[1] == "s" else words[: int(draw.integers(3, 12))] if m[1] == "t" else words
                labels.append(int(m[1] in "mt"))
                return html.escape(" ".join(words))

            made = blocks(mark.sub(fill, layout))
            if len(made) == len(labels):
                out.append((made, labels))
    return out


def fit(pages: DataFrame, fit_pages: int = FIT_PAGES, html_col: str = "html") -> Field:
    """Trains on at most about ``fit_pages`` pages, drawn by a hash of the page, and on the layouts."""
    rows = pages.select(F.xxhash64(html_col).alias("h"), F.col(html_col).alias("html")).filter("html is not null")
    total = max(1, rows.count())
    share = int(1_000_000 * min(1.0, fit_pages / total))
    drawn = rows.filter(F.pmod("h", F.lit(1_000_000)) < share).limit(2 * fit_pages).collect()
    parsed = [(b, y) for b in (blocks(r["html"]) for r in sorted(drawn, key=lambda r: r["h"])) if (y := marked_labels(b)) is not None]
    layouts = layout_pages(parsed[:100], 30)
    made = [(features(b, marks), y) for b, y in parsed + layouts for marks in (True, False)]
    return Field().train(made)


def main_text(page: str, model: Field) -> str:
    found = blocks(page)
    return "\n\n".join(b.text for b, y in zip(found, model.decode(features(found))) if y)


def extract_text(pages: DataFrame, model: Field, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row; null or empty html gives an empty text.

    Pages are read whole, in time and memory that follow their length; repeated rows give equal texts, an empty table no
    rows. Other columns are left out, whatever their names.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text_or_empty(html_col).alias("html"))
    cast = pages.sparkSession.sparkContext.broadcast(model)

    def apply(batches):
        for batch in batches:
            texts = [main_text(h, cast.value) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = [rows.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return rows.mapInArrow(apply, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")


def op8_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract_text(pages, fit(pages))
