"""Operator 4: main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is read into leaf blocks: runs of text between the borders of block elements, each with its ancestors. Features are the ancestor
tags, word groups in ancestor classes and ids, and properties of the text. The field scores a keep or drop label of each block and of
each pair of neighbours; it is trained by gradient ascent on labelled pages (made from page layouts with known labels), and Viterbi decodes
the best labelling of a whole page.

Character references are decoded, white space inside a block becomes one space, blocks that stay are joined by \\n. Scripts,
styles, templates, the head, comments of the markup and the inside of closed media elements are no text. Reading is linear in the page, however deep it is nested. Null and empty pages, and pages without a kept block, give an empty text. Unclosed and
stray tags are tolerated; rows are independent, so ties and repeated rows need no rule. An empty table gives an empty result.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wavepanel.llm.names import carried, ddl, quoted, unused

BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                       "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
SILENT_TAGS = frozenset("head script style template noscript svg iframe select option textarea title math datalist".split())
#: Their text is for readers without them, unless they are left open.
MEDIA_TAGS = frozenset("audio video object canvas".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that a new one closes where they are still open, up to the nearest container.
CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
CLOSES = {k: frozenset(v.split()) for k, v in CLOSES.items()}
FENCES = frozenset("ul ol dl table menu nav article section div body td".split())

#: Words in classes and ids that speak for a kind of block. Fixed values.
GROUPS = {
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs crumbs topbar toolbar pagination pager tabs toc skip sitemap",
    "head": "header masthead branding logo hero topline head",
    "foot": "footer foot colophon copyright legal bottom imprint credits",
    "side": "sidebar side aside widget widgets rail related recommended recommendations trending popular more teaser teasers tags tagcloud archive",
    "notice": "cookie cookies consent gdpr notice notices alert alerts popup modal overlay disclaimer warning message banner paywall announcement",
    "advert": "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promoted outbrain taboola",
    "comment": "comment comments commentlist reply replies respond response responses disqus discussion thread feedback reactions",
    "form": "form search login signin signup subscribe subscription newsletter register",
    "share": "share sharing social follow buttons",
    "content": "content article post entry story main body text prose page maintext articlebody",
}
_GROUP_OF = {w: g for g, words in GROUPS.items() for w in words.split()}
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
SECTION_TAGS = frozenset("nav header footer aside form article main section ul ol table blockquote pre figure figcaption button label fieldset "
                         "h1 h2 h3 h4 h5 h6 p li td dl div address details dialog menu".split())


@lru_cache(maxsize=20_000)
def _groups(names: str) -> tuple[str, ...]:
    return tuple(sorted({_GROUP_OF[w] for w in (x.lower() for x in _PARTS.findall(names)) if w in _GROUP_OF}))


class Context(NamedTuple):
    """What a block's ancestors say, kept with each open element so that nesting costs nothing per block."""
    tags: frozenset[str] = frozenset()
    groups: frozenset[str] = frozenset()
    leaf: str = "none"              # the nearest section tag
    content: bool = False           # an article, main or content element is open
    apart: bool = False             # something that is no content lies between the nearest of them and the block

    def inside(self, tag: str, groups: tuple[str, ...]) -> Context:
        """The context within an element."""
        section = tag in SECTION_TAGS
        main = tag in ("article", "main") or "content" in groups
        apart = bool(set(groups) - {"content", "head"}) or tag in ("aside", "nav", "form", "footer", "button")
        return Context(self.tags if not section or tag in self.tags else self.tags | {tag},
                       self.groups if self.groups.issuperset(groups) else self.groups.union(groups), tag if section else self.leaf,
                       self.content or main, apart if main else (self.content and (self.apart or apart)))


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, Context]] = []
        self.count: dict[str, int] = {}
        self.blocks: list[tuple[str, float, Context]] = []
        self.parts: list[str] = []
        self.linked = 0
        self.silent = 0
        self.media: list[int] | None = None                     # depth of the outermost media element, blocks, parts and linked signs before it

    def emit(self, parts: list[str], linked: int) -> None:
        text = " ".join("".join(parts).split())
        if text:
            self.blocks.append((text, linked / max(1, sum(map(len, parts))), self.open[-1][1] if self.open else Context()))

    def flush(self) -> None:
        if self.media and self.media[2]:                         # what stood before a media element is a block of its own
            _, _, parts, linked = self.media
            self.emit(self.parts[:parts], linked)
            del self.parts[:parts]
            self.linked -= linked
            self.media[1:] = [len(self.blocks), 0, 0]
        if self.parts:
            self.emit(self.parts, self.linked)
            self.parts, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID_TAGS:
            if tag in BLOCK_TAGS:
                self.flush()
            elif tag == "br":
                self.parts.append(" ")
            return
        if tag in SILENT_TAGS:
            self.silent += 1
        elif tag == "body" and self.silent:                      # a head left open ends here
            self.silent = 0
            self.open = [o for o in self.open if o[0] not in SILENT_TAGS]
            for silent in SILENT_TAGS:
                self.count.pop(silent, None)
        if tag in BLOCK_TAGS:
            self.flush()
            if tag in CLOSES:
                self.close_until(CLOSES[tag])
            if self.count.get("p"):
                self.close_until(frozenset(("p",)))
        if tag in MEDIA_TAGS and not self.media:
            self.media = [len(self.open), len(self.blocks), len(self.parts), self.linked]
        names = " ".join(v for k, v in attrs if v and k in ("class", "id", "role", "itemprop"))
        outer = self.open[-1][1] if self.open else Context()
        self.open.append((tag, outer.inside(tag, _groups(names) if names else ())))
        self.count[tag] = self.count.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID_TAGS:
            self.handle_starttag(tag, attrs)

    def close_until(self, tags: frozenset[str]) -> None:
        if not any(self.count.get(t) for t in tags):
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in tags:
                self.drop_to(i)
                return
            if self.open[i][0] in FENCES:
                return

    def drop_to(self, at: int) -> None:
        for tag, _ in self.open[at:]:
            self.count[tag] = max(0, self.count.get(tag, 0) - 1)
            if tag in SILENT_TAGS:
                self.silent = max(0, self.silent - 1)
        del self.open[at:]
        if self.media and at <= self.media[0]:
            self.media = None

    def handle_endtag(self, tag: str) -> None:
        if not self.count.get(tag):
            if tag in BLOCK_TAGS:
                self.flush()
            return
        i = len(self.open) - 1
        while self.open[i][0] != tag:
            i -= 1
        if self.media and i == self.media[0]:                    # closed as it should be: what it holds is for readers without media
            _, blocks, parts, self.linked = self.media
            del self.blocks[blocks:], self.parts[parts:]
        if tag in BLOCK_TAGS:
            self.flush()
        self.drop_to(i)

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append(data)
            if self.count.get("a"):
                self.linked += len(data)


def leaf_blocks(html: str) -> list[tuple[str, float, Context]]:
    """(text, share of linked text, context) of each leaf block in page order."""
    reader = _Reader()
    reader.feed(html)
    reader.close()
    reader.flush()
    return reader.blocks


_END = re.compile(r"[.!?…:;\"'»”)]$")
_SIGN = re.compile(r"[©®™]|\(c\) ")


def block_features(blocks: list[tuple[str, float, Context]]) -> list[list[str]]:
    """Names of the features of each block."""
    whole = any(context.content for _, _, context in blocks)
    out = []
    for i, (text, linked, context) in enumerate(blocks):
        tags, groups = context.tags, context.groups
        f = ["bias", *("tag:" + t for t in sorted(tags)), *("group:" + g for g in sorted(groups)), "leaf:" + context.leaf]
        if whole:
            f.append("inside" if context.content else "outside")
            if context.apart:
                f.append("inside:apart")
        else:
            f.append("no content element")
        if not tags - {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "section"} and not groups:
            f.append("plain")
        n = len(text.split())
        f.append("words:" + ("1" if n < 2 else "3" if n < 4 else "10" if n < 11 else "30" if n < 31 else "more"))
        f.append("linked:" + ("none" if linked == 0 else "some" if linked < 0.5 else "most"))
        f.append("ends" if _END.search(text) else "open end")
        if _SIGN.search(text):
            f.append("rights sign")
        f.append("first" if i == 0 else "last" if i == len(blocks) - 1 else "middle")
        out.append(f)
    return out


@dataclass(frozen=True)
class Field:
    places: dict[str, int]
    weights: np.ndarray             # features x 2
    steps: np.ndarray               # 2 x 2, from and to
    start: np.ndarray

    def emissions(self, features: list[list[str]]) -> np.ndarray:
        return np.array([self.weights[[self.places[x] for x in f if x in self.places]].sum(0) for f in features]).reshape(-1, 2)

    def decode(self, features: list[list[str]]) -> list[int]:
        """The best labelling: 1 keeps a block."""
        if not features:
            return []
        e = self.emissions(features)
        s, t = self.steps.tolist(), e.tolist()
        best = [t[0][k] + float(self.start[k]) for k in (0, 1)]
        back = []
        for row in t[1:]:
            came = [0 if best[0] + s[0][k] >= best[1] + s[1][k] else 1 for k in (0, 1)]
            best = [best[came[k]] + s[came[k]][k] + row[k] for k in (0, 1)]
            back.append(came)
        label = [int(best[1] > best[0])]
        for came in reversed(back):
            label.append(came[label[-1]])
        return label[::-1]


def fit_field(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 300, penalty: float = 1e-3) -> Field:
    """Maximum likelihood with an L2 penalty; forward and backward sums run over all pages at once."""
    places = {f: i for i, f in enumerate(sorted({f for features, _ in pages for block in features for f in block}))}
    n, longest = len(pages), max(len(y) for _, y in pages)
    x = np.zeros((n, longest, len(places)), np.float32)
    y = np.zeros((n, longest), np.int64)
    real = np.zeros((n, longest), bool)
    for i, (features, labels) in enumerate(pages):
        for j, block in enumerate(features):
            x[i, j, [places[f] for f in block]] = 1
        y[i, :len(labels)] = labels
        real[i, :len(labels)] = True
    flat = x.reshape(-1, len(places))
    hot = np.eye(2)[y] * real[..., None]
    pair = real[:, 1:]
    seen_steps = np.einsum("ija,ijb->ab", hot[:, :-1] * pair[..., None], hot[:, 1:])
    w, s, b = np.zeros((len(places), 2)), np.zeros((2, 2)), np.zeros(2)
    memory = [np.zeros_like(v) for v in (w, s, b)]
    total = real.sum()

    def norm(v: np.ndarray) -> np.ndarray:
        top = v.max(-1, keepdims=True)
        return top + np.log(np.exp(v - top).sum(-1, keepdims=True))

    for step in range(rounds):
        e = (flat @ w).reshape(n, longest, 2) * real[..., None]
        forward, backward = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        forward[:, 0] = e[:, 0] + b
        for j in range(1, longest):
            nxt = norm((forward[:, j - 1, :, None] + s).swapaxes(1, 2))[..., 0] + e[:, j]
            forward[:, j] = np.where(real[:, j, None], nxt, forward[:, j - 1])
        for j in range(longest - 2, -1, -1):
            nxt = norm(s + (e[:, j + 1] + backward[:, j + 1])[:, None, :])[..., 0]
            backward[:, j] = np.where(real[:, j + 1, None], nxt, 0)
        z = norm(forward[:, -1])
        marginal = np.exp(forward + backward - z[:, None]) * real[..., None]
        both = np.exp(forward[:, :-1, :, None] + s + (e[:, 1:] + backward[:, 1:])[:, :, None, :] - z[:, None, :, None]) * pair[..., None, None]
        grads = ((flat.T @ (hot - marginal).reshape(-1, 2)) / total - penalty * w, (seen_steps - both.sum((0, 1))) / total - penalty * s,
                 (hot[:, 0] - marginal[:, 0]).sum(0) / total - penalty * b)
        for v, g, m in zip((w, s, b), grads, memory, strict=True):
            m += g * g
            v += 0.3 * g / (np.sqrt(m) + 1e-8)
    return Field(places, w, s, b)


# --- labelled pages ---

def labelled_pages(count: int = 260, seed: int = 5) -> list[tuple[str, list[str]]]:
    """(html, texts of the article's blocks in order): page layouts with and without section elements, filled with made-up words."""
    rng = random.Random(seed)

    def some(low: int, high: int) -> str:
        words = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(low, high))]
        return " ".join(words).capitalize()

    def prose() -> str:
        n = rng.choice((1, 1, 2, 3, 4))
        return " ".join(some(*rng.choice(((1, 2), (4, 12), (10, 40)))) + rng.choice((".", ".", "!", "?", "")) for _ in range(n))

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{i}">{some(1, 3)}</a></li>' for i in range(n))

    def named(group: str, *but: str) -> str:
        word = rng.choice([w for w in GROUPS[group].split() if w not in but])
        return rng.choice((f'class="{word}"', f'id="{word}"', f'class="{word}-{rng.choice(("box", "area", "wrap", "item", "1"))}"', f'class="x {word}"'))

    def boiler(kind: str) -> str:
        filler = rng.choice((lambda: f"<ul>{links(rng.randint(2, 7))}</ul>", lambda: f"<p>{prose()}</p>", prose, lambda: some(2, 8),
                             lambda: f"<h3>{some(1, 3)}</h3><p>{prose()}</p>", lambda: f'<a href="#">{some(1, 4)}</a>'))
        if kind == "nav":
            inner = rng.choice((f"<ul>{links(rng.randint(2, 8))}</ul>", " | ".join(f'<a href="#">{some(1, 2)}</a>' for _ in range(4))))
            return rng.choice((f"<nav>{inner}</nav>", f'<div {named("nav")}>{inner}</div>', f'<ul {named("nav")}>{links(5)}</ul>'))
        if kind == "head":
            inner = rng.choice((some(1, 4), f'<a href="/">{some(1, 3)}</a>', f"<h1>{some(1, 3)}</h1>", f"<p>{prose()}</p>"))
            return rng.choice((f"<header>{inner}</header>", f'<div {named("head")}>{inner}</div>'))
        if kind == "foot":
            inner = rng.choice((f"&copy; {some(1, 3)}", f"&copy; {some(1, 2)} &middot; {prose()}", filler(), f"<p>{prose()}</p>"))
            return rng.choice((f"<footer>{inner}</footer>", f"<footer>{inner}</footer>", f'<div {named("foot")}>{inner}</div>'))
        if kind == "side":
            return rng.choice((f"<aside>{filler()}</aside>", f'<div {named("side")}>{filler()}</div>', f'<section {named("side")}>{filler()}</section>'))
        if kind == "comment":
            items = "".join(rng.choice(("<div {0}><p>{1}</p></div>", "<li {0}>{1}</li>", "<p>{1}</p>", "<article {0}><p>{1}</p></article>"))
                            .format(named("comment"), prose()) for _ in range(rng.randint(1, 5)))
            return rng.choice((f'<section {named("comment")}><h2>{some(1, 2)}</h2>{items}</section>', f'<div {named("comment")}>{items}</div>'))
        if kind == "form":
            return rng.choice((f'<form><label>{some(1, 3)}</label><input name="q"><button>{some(1, 1)}</button></form>', f"<form><p>{prose()}</p><button>{some(1, 2)}</button></form>",
                               f'<div {named("form")}>{prose()}</div>'))
        if kind == "share":
            return f'<div {named("share")}>{rng.choice((f"<ul>{links(3)}</ul>", some(1, 4)))}</div>'
        return f"<div {named(kind)}>{filler()}</div>"

    pages = []
    for _ in range(count):
        kept: list[str] = []

        def keep(tag: str, text: str, kept: list[str] = kept) -> str:
            kept.append(text)
            body = text if rng.random() < 0.85 else f"<b>{text}</b>"
            return f"<{tag}>{body}" + ("" if tag in ("p", "li") and rng.random() < 0.15 else f"</{tag}>")

        def article(kept: list[str] = kept) -> str:
            out = [keep("h1", some(2, 9))] if rng.random() < 0.8 else []
            for _ in range(rng.randint(1, 9)):
                kind = rng.random()
                if kind < 0.56:
                    out.append(keep("p", prose()))
                elif kind < 0.62:
                    out.append(keep("div", rng.choice((prose(), some(1, 4)))))
                elif kind < 0.7:
                    out.append(keep(rng.choice(("h2", "h3", "blockquote", "pre")), some(2, 8)))
                elif kind < 0.76:
                    out.append("<ul>" + "".join(keep("li", prose()) for _ in range(3)) + "</ul>")
                elif kind < 0.8:
                    out.append("<figure><img src=x>" + keep("figcaption", some(3, 9)) + "</figure>")
                elif kind < 0.84:
                    text = f"{some(3, 9)} and {some(1, 3)} {some(2, 9)}."
                    kept.append(text)
                    first, last = text.split(" and ", 1)
                    out.append(f'<p>{first} and <a href="#">{last}</a></p>')
                elif kind < 0.88:
                    out.append("<table><tr>" + keep("td", some(1, 4)) + keep("td", some(1, 4)) + "</tr></table>")
                else:
                    out.append(boiler(rng.choice(("advert", "advert", "side", "share", "form", "notice", "comment"))))
            return "".join(out)

        before = [boiler(k) for k in rng.sample(("nav", "head", "notice", "advert", "form", "nav"), rng.randint(0, 4))]
        after = [boiler(k) for k in rng.sample(("side", "comment", "foot", "advert", "notice", "share", "nav", "form"), rng.randint(0, 5))] + ([boiler("foot")] if rng.random() < 0.6 else [])
        layout = rng.choice(("<article>{}</article>", "<article>{}</article>", "<main><article>{}</article></main>", "<main>{}</main>", f'<div {named("content", "body", "text")}>{{}}</div>',
                             f'<section {named("content")}>{{}}</section>', "{}", "<div>{}</div>"))
        middle = layout.format(article())
        if rng.random() < 0.25 and layout != "{}":
            side = boiler("side")
            middle = rng.choice((side + middle, middle + side))
        head = f"<head><title>{some(2, 6)}</title><style>p{{}}</style></head>" if rng.random() < 0.7 else ""
        pages.append((f"<html>{head}<body>{''.join(before)}{middle}{''.join(after)}</body></html>", kept))
    return pages


@lru_cache(maxsize=1)
def trained_field() -> Field:
    """Fit on the labelled pages; a block is content if it is the next text of the article."""
    pages = []
    for html, kept in labelled_pages():
        blocks = leaf_blocks(html)
        labels, at = [], 0
        for text, _, _ in blocks:
            hit = at < len(kept) and text == " ".join(kept[at].split())
            labels.append(int(hit))
            at += hit
        if blocks:
            pages.append((block_features(blocks), labels))
    return fit_field(pages)


def main_text(html: str, field: Field) -> str:
    blocks = leaf_blocks(html)
    return "\n".join(text for (text, _, _), label in zip(blocks, field.decode(block_features(blocks)), strict=True) if label)


def extract(pages: DataFrame, html: str = "html", output: str = "text", field: Field | None = None) -> DataFrame:
    """The columns of pages but the html, with the main text, which replaces a column of its name."""
    columns = carried(pages, [output], [html])
    shared = pages.sparkSession.sparkContext.broadcast(field or trained_field())
    schema = ddl(pages, columns, {output: "string"})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h or "", shared.value) for h in batch.column(len(columns)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*columns, output])

    return pages.select(*[pages[quoted(c)] for c in columns], pages[quoted(html)].alias(unused(pages) + "html")).mapInArrow(run, schema)
