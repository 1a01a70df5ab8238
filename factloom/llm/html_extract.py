"""Main text of HTML pages: a linear-chain conditional random field over leaf blocks.

A page is scanned once into leaf blocks: runs of text between block-level tags,
with the open elements above them. Each block has binary features of its
ancestors' tags, of the words in their class, id and role attributes, of its own
tag and of its text (length, links, punctuation, capitals, marks such as the
copyright sign, place in the page). The field has the labels main text and other
text, a weight for each feature and label, and a weight for each pair of
neighbouring labels; Viterbi decoding labels all blocks of a page together.

Training is on labelled pages that ``labelled_pages`` writes from a seed: layouts
of articles with menus, headers, sidebars, notices, adverts, forms, footers and
reader comments under many usual names, in invented words. Nothing is learned
from the pages that are judged, so the model is the same at every size.

Text: character references are decoded, white space in a block becomes one space,
blocks are trimmed and joined by an empty line. Scripts, styles, form controls
and comments of the markup are never text. Headings inside the article belong to
it.

Defined cases: null html is the empty page, of empty text; broken or cut markup is
read as far as it goes (a cut tag at the end is no text, an unknown character
reference stays as it is). Pages are read whole; repeated rows repeat; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import cached_property, lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from factloom.llm.common import map_rows, table

SCHEMA = "page_id long, url string, text string, n_chars long"

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html "
    "li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NO_TEXT = frozenset("button datalist head iframe noscript object option script select style svg template textarea title".split())
RAW = frozenset("script style textarea title iframe noscript".split())
# What may stand in a head; any other start tag, and text, ends a head whose end tag is left out.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
# Open elements beyond which a start tag ends no paragraph.
HOLD = ("td", "th", "div", "section", "article", "body")
# A start tag that ends an open element of these kinds, up to the given bounds.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<[!?/a-zA-Z][^>]*(?:>|\Z)""",
    re.DOTALL,
)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    tag: str
    tags: frozenset[str]
    names: frozenset[str]
    text: str = ""
    linked: int = 0


def leaf_blocks(html: str, known: frozenset[str] | None = None) -> list[Block]:
    """The blocks of a page that hold text, in order; of names and tags only the known ones, if given.

    The time is linear in the page: each element is opened and closed once, and an end
    tag finds its element by the tag's open places.
    """
    out: list[Block] = []
    known_tags = known or frozenset()
    # Open elements: tag, its names, place of the innermost block at or around it (-1: none).
    stack: list[tuple[str, frozenset[str], int]] = []
    places: dict[str, list[int]] = {}  # of each open tag, outermost first
    open_names: dict[str, int] = {}  # how many open elements have each name
    pieces: list[str] = []
    linked = silent = in_link = 0

    def last(tags: Iterable[str]) -> int:
        """Place of the innermost open element of these tags, or -1."""
        return max((places[t][-1] for t in tags if t in places), default=-1)

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        if text:
            tag = stack[stack[-1][2]][0] if stack and stack[-1][2] >= 0 else ""
            tags = frozenset(places) if known is None else known_tags & places.keys()
            out.append(Block(tag, tags, frozenset(open_names), text, linked))
        pieces.clear()
        linked = 0

    def pop(to: int) -> None:
        nonlocal silent, in_link
        if stack and stack[-1][2] >= to:
            flush()
        while len(stack) > to:
            t, names, _ = stack.pop()
            places[t].pop()
            if not places[t]:
                del places[t]
            for x in names:
                open_names[x] -= 1
                if not open_names[x]:
                    del open_names[x]
            silent -= t in NO_TEXT
            in_link -= t == "a"

    def add(raw: str) -> None:
        nonlocal linked
        if silent and stack[-1][0] == "head" and raw and not raw.isspace():
            pop(len(stack) - 1)
        if raw and not silent:
            text = unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if in_link:
                linked += len(text.strip())

    at = 0
    while m := _TOKEN.search(html, at):
        add(html[at : m.start()])
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        name = name.lower()
        if m.group(1):
            depth = last((name,))
            # An inline end tag does not reach through a block.
            if depth >= 0 and (name in BLOCKS or name in NO_TEXT or stack[-1][2] <= depth):
                pop(depth)
            continue
        if stack and stack[-1][0] == "head" and name not in IN_HEAD:
            pop(len(stack) - 1)
        if name in BLOCKS:
            closed, bounds = CLOSES.get(name, ((), ()))
            inner = last((*closed, "p"))
            # An element both closed and a bound is closed.
            if inner >= 0 and inner >= last((*bounds, *HOLD)):
                pop(inner)
            inner = last(closed)
            if inner >= 0 and inner > last(bounds):
                pop(inner)
            flush()
        if name in VOID:
            if name == "br" and not silent:
                pieces.append(" ")
            continue
        attributes = m.group(3)
        if attributes.endswith("/") and name not in BLOCKS:
            continue
        names = frozenset(p.lower() for a in _NAMES.findall(attributes) for p in _PARTS.findall(a)) if attributes else frozenset()
        names = names if known is None else names & known
        for x in names:
            open_names[x] = open_names.get(x, 0) + 1
        places.setdefault(name, []).append(len(stack))
        stack.append((name, names, len(stack) if name in BLOCKS else stack[-1][2] if stack else -1))
        silent += name in NO_TEXT
        in_link += name == "a"
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(html, at)
            at = end.end() if end else len(html)
            pop(len(stack) - 1)
    add(html[at:])
    flush()
    return out


def features(blocks: list[Block]) -> list[list[str]]:
    """The names of each block's features."""
    out = []
    for i, b in enumerate(blocks):
        words = b.text.count(" ") + 1
        size = len(b.text)
        f = ["bias", f"tag={b.tag}", f"words={min(words.bit_length(), 7)}", f"links={round(4 * min(1, b.linked / size))}"]
        f += [f"in={t}" for t in set(b.tags) if t not in ("html", "body")]
        f += [f"name={n}" for n in b.names]
        marks = sum(b.text.count(c) for c in ".!?;:")
        f.append(f"marks={min(3, marks)}")
        if b.text[-1] in ".!?\"'”»":
            f.append("ends")
        if any(c in b.text for c in "©®™·|»›"):
            f.append("sign")
        if b.text.isupper():
            f.append("upper")
        if i == 0:
            f.append("first")
        if i == len(blocks) - 1:
            f.append("last")
        f.append("article" if "article" in b.tags else "main" if "main" in b.tags else "loose")
        out.append(f)
    return out


@dataclass
class ChainField:
    """Weights of features and of neighbouring labels; label 1 is main text."""

    weights: dict[str, tuple[float, float]] = field(default_factory=dict)
    moves: tuple[tuple[float, float], tuple[float, float]] = ((0.0, 0.0), (0.0, 0.0))

    @cached_property
    def known(self) -> frozenset[str]:
        """The names and tags that have a weight, and the tags that features ask for."""
        return frozenset(n.partition("=")[2] for n in self.weights if n.startswith(("name=", "in="))) | {"article", "main"}

    def decode(self, sequence: list[list[str]]) -> list[int]:
        """Viterbi: the labels of highest total weight."""
        zero, best, back = (0.0, 0.0), None, []
        get, moves = self.weights.get, self.moves
        for names in sequence:
            a = b = 0.0
            for n in names:
                w = get(n, zero)
                a += w[0]
                b += w[1]
            if best is None:
                best = (a, b)
                continue
            to = [max((best[y] + moves[y][z], y) for y in (0, 1)) for z in (0, 1)]
            back.append((to[0][1], to[1][1]))
            best = (to[0][0] + a, to[1][0] + b)
        if best is None:
            return []
        labels = [int(best[1] > best[0])]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]

    @classmethod
    def train(cls, sequences: list[list[list[str]]], labels: list[list[int]], rounds: int = 150, rate: float = 0.1, ridge: float = 2e-4) -> ChainField:
        """Conditional likelihood by gradient steps (Adam), all sequences at once."""
        index = {n: i for i, n in enumerate(sorted({n for s in sequences for names in s for n in names}))}
        n, most = len(sequences), max(map(len, sequences))
        width = max(len(names) for s in sequences for names in s)
        inputs = np.full((n, most, width), len(index))
        gold, real = np.zeros((n, most), int), np.zeros((n, most), bool)
        for i, (s, y) in enumerate(zip(sequences, labels)):
            gold[i, : len(y)], real[i, : len(y)] = y, True
            for t, names in enumerate(s):
                inputs[i, t, : len(names)] = [index[x] for x in names]
        w, m = np.zeros((len(index) + 1, 2)), np.zeros((2, 2))
        truth = np.eye(2)[gold] * real[:, :, None]
        pairs = real[:, 1:]
        true_moves = np.einsum("nta,ntb->ab", truth[:, :-1] * pairs[:, :, None], truth[:, 1:])
        moment = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, m)]
        for step in range(1, rounds + 1):
            score = w[inputs].sum(axis=2)
            forward, backward = np.zeros((n, most, 2)), np.zeros((n, most, 2))
            forward[:, 0] = score[:, 0]
            for t in range(1, most):
                into = np.logaddexp.reduce(forward[:, t - 1, :, None] + m, axis=1) + score[:, t]
                forward[:, t] = np.where(real[:, t, None], into, forward[:, t - 1])
            for t in range(most - 2, -1, -1):
                into = np.logaddexp.reduce(m + (score[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
                backward[:, t] = np.where(real[:, t + 1, None], into, 0)
            total = np.logaddexp.reduce(forward[:, -1], axis=1)
            belief = np.exp(forward + backward - total[:, None, None]) * real[:, :, None]
            joint = np.exp(forward[:, :-1, :, None] + m + (score[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None]) * pairs[:, :, None, None]
            slope = np.zeros_like(w)
            np.add.at(slope, inputs.reshape(-1, width), np.repeat(((belief - truth) / n).reshape(-1, 1, 2), width, axis=1))
            slope[-1] = 0
            slopes = (slope + ridge * w, (joint.sum(axis=(0, 1)) - true_moves) / n + ridge * m)
            for x, g, (one, two) in zip((w, m), slopes, moment):
                one += 0.1 * (g - one)
                two += 0.001 * (g * g - two)
                x -= rate * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.999**step)) + 1e-8)
            w[-1] = 0
        return cls({name: tuple(w[i].tolist()) for name, i in index.items()}, tuple(map(tuple, m.tolist())))


# ---------------------------------------------------------------- labelled pages

# Names under which pages keep their parts.
OTHER_NAMES = {
    "menu": "nav navbar navigation menu topnav breadcrumb breadcrumbs pagination pager toc tabs",
    "header": "header masthead site-header page-header topbar branding logo",
    "footer": "footer site-footer page-footer copyright colophon legal",
    "side": "sidebar side widget widget-area related recommended popular rail trending tags share social meta",
    "notice": "notice cookie cookie-notice cookies consent gdpr alert banner popup modal disclaimer paywall message",
    "advert": "ad ads advert advertisement sponsored sponsor promo promotion adbox ad-slot banner-ad",
    "form": "form newsletter subscribe signup search searchform login contact-form",
    "comments": "comments comment comment-list commentlist discussion replies reply responses disqus reader-comments",
}
MAIN_NAMES = "content post entry article story body article-body post-content entry-content main text hentry page-content".split()


def labelled_pages(count: int, seed: int = 7) -> list[tuple[str, list[tuple[str, int]]]]:
    """Pages with the label of each block of text, in page order."""
    rng = random.Random(seed)
    syllables = "the an er on re in ti ed st en nd or at is it le au de ra um ça é ö ü ñ ki mo da sch eau".split()
    counter = [0]

    def words(low: int, high: int) -> str:
        counter[0] += 1  # a number of its own makes each block's text unlike all others
        n = rng.choice((rng.randint(low, high), rng.randint(low, min(high, low + 6))))
        text = " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) + (rng.choice(",.") if rng.random() < 0.2 else "") for _ in range(n))
        return text.capitalize()

    def page() -> tuple[str, list[tuple[str, int]]]:
        truth: list[tuple[str, int]] = []

        def block(tag: str, text: str, label: int, attributes: str = "") -> str:
            truth.append((text, label))
            close = f"</{tag}>" if rng.random() < 0.9 or tag not in ("p", "li") else ""
            inner = f"<b>{text}" if label and tag == "p" and rng.random() < 0.1 else f"<a href='/x'>{text}</a>" if "link" in attributes else text
            return f"<{tag}>{inner}{close}"

        def links(n: int) -> str:
            return "<ul>" + "".join(block("li", words(1, 4), 0, "link") for _ in range(n)) + "</ul>"

        def other(kind: str) -> str:
            name = rng.choice(OTHER_NAMES[kind].split())
            tag = {"menu": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form", "comments": "section"}.get(kind, "div")
            named = rng.random() < 0.75
            tag = tag if kind not in ("notice", "advert") and (not named or rng.random() < 0.6) else rng.choice(("div", "section")) if kind != "form" else "form"
            attribute = f' {rng.choice(("class", "id"))}="{name}"' if named or tag in ("div", "section") else ""
            ends = "." if rng.random() < 0.5 else ""
            if kind == "menu":
                inner = links(rng.randint(2, 7))
            elif kind == "footer":
                inner = block(rng.choice(("p", "div", "span")), "© " * (rng.random() < 0.6) + words(2, 14) + ends, 0)
            elif kind == "side":
                inner = block("h3", words(1, 4), 0) + (links(3) if rng.random() < 0.6 else block("p", words(3, 30) + ends, 0))
            elif kind == "comments":
                inner = block("h3", words(1, 3), 0) + "".join(f'<div class="{rng.choice(("comment", "reply", "user-comment"))}">' + block("p", words(2, 40) + ".", 0) + "</div>" for _ in range(rng.randint(1, 4)))
            elif kind == "form":
                inner = block("label", words(1, 4), 0) + "<input><button>Go</button>"
            elif kind == "header":
                inner = block(rng.choice(("div", "h2", "p")), words(1, 6), 0) + (links(3) if rng.random() < 0.4 else "")
            else:
                text = words(2, 30) + ends
                inner = block("p", text, 0) if rng.random() < 0.5 else text
                if inner is text:
                    truth.append((text, 0))
            return f"<{tag}{attribute}>{inner}</{tag}>"

        def article(most: int = 12) -> str:
            out = [block(rng.choice(("h1", "h1", "h1", "h1", "h2")), words(1, 10), 1)] if rng.random() < (0.8 if most > 2 else 0.4) else []
            for _ in range(rng.randint(1, most)):
                roll = rng.random() if most > 2 else 0.0
                if roll < 0.72:
                    out.append(block("p", words(1, 90) + ("." if rng.random() < 0.85 else ""), 1))
                elif roll < 0.8:
                    out.append(block(rng.choice(("h2", "h3")), words(1, 7), 1))
                elif roll < 0.85:
                    out.append("<ul>" + "".join(block("li", words(1, 20), 1) for _ in range(rng.randint(2, 4))) + "</ul>")
                elif roll < 0.88:
                    out.append(block(rng.choice(("blockquote", "pre")), words(3, 30), 1))
                elif roll < 0.9:
                    out.append("<table><tr>" + "".join(block("td", words(1, 4), 1) for _ in range(3)) + "</tr></table>")
                elif roll < 0.92:
                    out.append("<figure>" + block("figcaption", words(2, 12), 1) + "</figure>")
                else:
                    out.append(other(rng.choice(("advert", "side", "form", "notice", "menu"))))
            if rng.random() < 0.15:
                out.append(other("comments"))
            name = rng.choice(MAIN_NAMES)
            tag = rng.choice(("article", "article", "main", "div", "section"))
            attribute = f' {rng.choice(("class", "id"))}="{name}"' if tag in ("div", "section") or rng.random() < 0.3 else ""
            html = f"<{tag}{attribute}>" + "".join(out) + f"</{tag}>"
            return f"<main>{html}</main>" if tag == "article" and rng.random() < 0.3 else html

        if rng.random() < 0.08:  # a page that is an article and nothing else
            return article(2), truth
        parts = ["<html><head><title>x</title></head><body>"]
        parts += [other(k) for k in ("notice", "header", "menu", "advert", "form", "side") if rng.random() < 0.45]
        if rng.random() < 0.97:
            parts.append(article())
        parts += [other(k) for k in ("advert", "comments", "side", "form", "notice", "menu", "footer") if rng.random() < 0.4]
        return "".join(parts) + "</body></html>", truth

    return [page() for _ in range(count)]


@lru_cache(maxsize=2)
def trained(pages: int = 600, seed: int = 7) -> ChainField:
    """The field, trained on pages whose blocks carry labels."""
    sequences, labels = [], []
    for html, truth in labelled_pages(pages, seed):
        blocks = leaf_blocks(html)
        if blocks and [b.text for b in blocks] == [" ".join(t.split()) for t, _ in truth]:
            sequences.append(features(blocks))
            labels.append([y for _, y in truth])
    return ChainField.train(sequences, labels)


def main_text(html: str | None, model: ChainField) -> str:
    blocks = leaf_blocks(html or "", model.known)
    return "\n\n".join(b.text for b, y in zip(blocks, model.decode(features(blocks))) if y)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each page."""
    model = trained()

    def run(batch: pa.RecordBatch) -> dict:
        found = [main_text(h, model) for h in batch.column("html").to_pylist()]
        return {"page_id": batch.column("page_id").cast(pa.int64()), "url": batch.column("url").cast(pa.string()), "text": found, "n_chars": [len(t) for t in found]}

    return map_rows(pages.select("page_id", "url", "html"), SCHEMA, run)


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))
