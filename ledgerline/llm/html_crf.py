"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of a page's DOM.

A leaf block is a run of text between two borders of block-level elements. The field tags it as main text (1) or not (0)
from its ancestors (tags, words of class, id and role, near ones and all), its own text (length, closing mark, links,
capitals, a few words of notices), and its place (outside an `article` that the page has, before the title, in the container
that holds most text). Steps between neighbours differ for blocks of one parent and of two. Weights are fitted on the exact
conditional likelihood of labelled pages, and pages are decoded by Viterbi. No labelled pages come with the tables, so
`invented_pages` writes some from a fixed seed, of many layouts and with words of no language; what the field learns is
structure. Its weights are a few thousand numbers and travel with the task.

Reading a page is linear in its length, with the rules of browsers for broken markup: an open tag without end, comment
or script takes the rest of the page; character references are decoded; a new paragraph, item or cell closes the one
before. A line break is white space inside its block.

Cases: null and empty html, and pages with no main text, give an empty text with 0 characters; null ids and repeated rows
are kept as they are; an empty table gives an empty one; further columns are not read. Every page is read whole.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import read_table, slices

# ---- pages to blocks -----------------------------------------------------------------------------

#: Elements whose borders end a block.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend"
    " li main menu nav noscript ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content is not text of the page, up to their end tag.
RAW_TAGS = frozenset("script style title textarea iframe xmp noembed noframes template svg math object canvas audio video".split())
_VOID = frozenset(["hr"])
_HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
#: What an opening tag closes, if it is the innermost open block.
_CLOSES = {tag: frozenset(["p"]) for tag in BLOCK_TAGS} | {
    "li": frozenset(["p", "li"]), "dt": frozenset(["p", "dt", "dd"]), "dd": frozenset(["p", "dt", "dd"]), "option": frozenset(["option"]), "optgroup": frozenset(["option", "optgroup"]),
    "td": frozenset(["p", "td", "th"]), "th": frozenset(["p", "td", "th"]), "tr": frozenset(["p", "td", "th", "tr"]), "tbody": frozenset(["p", "td", "th", "tr", "thead", "tbody"]),
    "tfoot": frozenset(["p", "td", "th", "tr", "thead", "tbody"]), **{h: frozenset(["p"]) | _HEADINGS for h in _HEADINGS},
}

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=(?!\s*[\"']))*+)>")
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|itemprop|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?![^\s"'/>])""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW_TAGS}


class Element:
    """An open block-level element: `own` names hold its tag and words, `held` also its ancestors'."""

    __slots__ = ("chars", "held", "own", "parent", "tag")

    def __init__(self, tag: str, own: int, parent: Element | None):
        self.tag, self.own, self.parent, self.chars = tag, own, parent, 0
        self.held = own | parent.held if parent else own


class Block:
    __slots__ = ("element", "linked", "text")

    def __init__(self, text: str, linked: int, element: Element):
        self.text, self.linked, self.element = text, linked, element


class Names:
    """Numbers of names, as bits; new names get one only while the field is fitted."""

    def __init__(self, known: dict[str, int] | None = None):
        self.known, self.growing, self._seen = dict(known or {}), known is None, {}

    def bit(self, name: str) -> int:
        at = self.known.get(name)
        if at is None:
            if not self.growing:
                return 0
            at = self.known[name] = len(self.known)
        return 1 << at

    def of(self, tag: str, attributes: str) -> int:
        """The tag, the words of class, id, role and itemprop, and the last word of each of their names."""
        key = (tag, attributes)
        found = self._seen.get(key)
        if found is None:
            found = self.bit(f"<{tag}>")
            if tag not in ("html", "body") and attributes:
                for m in _ATTRIBUTE.finditer(attributes):
                    kind, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                    if kind in ("hidden", "aria-hidden") and value.lower() != "false" or kind == "style" and re.search(r"display\s*:\s*none", value, re.I):
                        found |= self.bit("hidden")
                    elif kind not in ("hidden", "aria-hidden", "style"):
                        for name in value.split():
                            words = [w.lower() for w in _WORD.findall(name)]
                            for word in words:
                                found |= self.bit(word)
                            if words:
                                found |= self.bit(f"{words[-1]}.")
            if len(attributes) < 300:
                if len(self._seen) > 20_000:
                    self._seen.clear()
                self._seen[key] = found
        return found


def blocks_of(page: str, names: Names) -> list[Block]:
    """The page's leaf blocks in order, white space in them turned into single spaces."""
    out: list[Block] = []
    stack, open_tags = [Element("html", names.of("html", ""), None)], {}
    parts: list[str] = []
    linked, in_link, at, end = 0, False, 0, len(page)

    def close_block() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, min(linked, len(text)), stack[-1]))
            parts.clear()
            linked = 0

    def add(text: str) -> None:
        nonlocal linked
        text = entities.unescape(text) if "&" in text else text
        parts.append(text)
        if in_link:
            linked += len(text.strip())

    def pop() -> None:
        open_tags[stack.pop().tag] -= 1

    while at < end:
        found = page.find("<", at)
        if found < 0:
            add(page[at:])
            break
        if found > at:
            add(page[at:found])
        m = _TAG.match(page, found)
        if m is None:
            after = page[found + 1 : found + 2]
            if page.startswith("<!--", found):
                short = re.compile("--?>").match(page, found + 4) if page.startswith(("<!-->", "<!--->"), found) else re.compile("--!?>").search(page, found + 4)
                at = short.end() if short else end
            elif after in ("!", "?", "/"):
                closing = page.find(">", found)
                at = closing + 1 if closing >= 0 else end
            elif after.isascii() and after.isalpha():
                at = end  # a tag that never ends
            else:
                add("<")
                at = found + 1
            continue
        at, tag = m.end(), m[2].lower()
        if m[1]:
            if tag == "a":
                in_link = False
            elif tag in BLOCK_TAGS:
                close_block()
                if open_tags.get(tag):
                    while stack[-1].tag != tag:
                        pop()
                    pop()
        elif tag in RAW_TAGS:
            parts.append(" ")
            if not m[3].rstrip().endswith("/") or tag not in ("svg", "math"):
                raw_end = _RAW_END[tag].search(page, at)
                at = raw_end.start() if raw_end else end
        elif tag in BLOCK_TAGS:
            close_block()
            closes = _CLOSES[tag]
            while len(stack) > 1 and stack[-1].tag in closes:
                pop()
            if tag not in _VOID:
                stack.append(Element(tag, names.of(tag, m[3]), stack[-1]))
                open_tags[tag] = open_tags.get(tag, 0) + 1
        elif tag == "a":
            in_link = True
        elif tag in ("br", "img", "input"):
            parts.append(" ")
    close_block()
    return out


# ---- features ------------------------------------------------------------------------------------

#: Words of notices, menus and the like; each counts in short blocks only.
NOTICE_WORDS = frozenset(
    "cookie cookies consent privacy terms copyright rights reserved subscribe newsletter login signin register share tweet follow advertisement sponsored comments reply replies comment"
    " search menu home contact skip related".split()
)
_LENGTHS = (1, 2, 4, 8, 16, 32, 64)
_LETTERS = re.compile(r"[^\W\d_]+")


def _level(value: float, steps: tuple) -> int:
    return sum(value >= s for s in steps)


def text_features(block: Block) -> list[str]:
    text = block.text
    n, n_words = len(text), text.count(" ") + 1
    length = _level(n_words if n < 30 * n_words else n // 6, _LENGTHS)  # without blanks, six characters count as a word
    ended = text[-1] in ".!?…。！？:;\"'”’»)"
    links = _level(block.linked / n, (0.01, 0.3, 0.7))
    out = [f"length {length}", f"length {length} ended {ended}", f"length {length} links {links}", f"links {links}", f"tag {block.element.tag}", f"tag {block.element.tag} length {min(length, 4)}"]
    if n < 200:
        upper = sum(map(str.isupper, text))
        if upper > 2 and 2 * upper > n:
            out.append("capitals")
        if any(mark in text for mark in "|©·»›•"):
            out.append("marks")
        out += {f"word {w}" for w in map(str.lower, _LETTERS.findall(text)) if w in NOTICE_WORDS}
    return out


def page_features(blocks: list[Block]) -> list[list[str]]:
    """What needs the whole page: its containers' shares of its text, and whether a block stands before its title."""
    total, titled = 1, False
    for b in blocks:
        size = len(b.text) - b.linked
        total += size
        titled |= b.element.tag == "h1"
        holder: Element | None = b.element
        for _ in range(3):
            if holder is not None:
                holder.chars += size
                holder = holder.parent
    seen, out = not titled, []
    for b in blocks:
        seen |= b.element.tag == "h1"
        parent = b.element.parent or b.element
        shares = [_level(x.chars / total, (0.1, 0.3, 0.6)) for x in (parent, parent.parent or parent)]
        out.append([f"parent {shares[0]}", f"above {shares[1]}", f"titled {titled} seen {seen}"])
    return out


def names_in(mask: int) -> Iterator[int]:
    while mask:
        low = mask & -mask
        yield low.bit_length() - 1
        mask ^= low


# ---- the field -----------------------------------------------------------------------------------


class Field:
    """Scores of main text against the rest for each feature, and of steps: [same parent or not][tag before][tag]."""

    def __init__(self, names: dict[str, int], weights: dict[str, float], steps: np.ndarray, ends: np.ndarray):
        self.names, self.weights, self.steps, self.ends = names, weights, steps, ends
        self.by_bit = {at: name for name, at in names.items()}
        self._masks: dict[tuple[str, int], float] = {}

    def __getstate__(self):
        return self.names, self.weights, self.steps, self.ends

    def __setstate__(self, state):
        self.__init__(*state)

    def of_mask(self, kind: str, mask: int) -> float:
        found = self._masks.get((kind, mask))
        if found is None:
            if len(self._masks) > 50_000:
                self._masks.clear()
            found = self._masks[kind, mask] = sum(self.weights.get(kind + self.by_bit[i], 0.0) for i in names_in(mask))
        return found

    def scores(self, blocks: list[Block], page_names: int) -> list[float]:
        get = self.weights.get
        out = []
        for b, whole in zip(blocks, page_features(blocks)):
            near = b.element.own | (b.element.parent.own if b.element.parent else 0)
            score = self.of_mask("in ", b.element.held) + self.of_mask("near ", near) + self.of_mask("outside ", page_names & ~b.element.held) + get("all", 0.0)
            for f in text_features(b):
                score += get(f, 0.0)
            for f in whole:
                score += get(f, 0.0)
            out.append(score)
        return out

    def decode(self, blocks: list[Block]) -> list[int]:
        """The most likely tags of all blocks together."""
        if not blocks:
            return []
        scores, steps = self.scores(blocks, outside_names(blocks, self.names)), self.steps.tolist()
        best, back = [self.ends[0, 0], self.ends[0, 1] + scores[0]], []
        for i in range(1, len(blocks)):
            step = steps[blocks[i].element.parent is blocks[i - 1].element.parent]
            to0, to1 = (best[0] + step[0][0], best[1] + step[1][0]), (best[0] + step[0][1], best[1] + step[1][1])
            back.append((int(to0[1] > to0[0]), int(to1[1] > to1[0])))
            best = [max(to0), max(to1) + scores[i]]
        tag = int(best[1] + self.ends[1, 1] > best[0] + self.ends[1, 0])
        tags = [tag]
        for choice in reversed(back):
            tag = choice[tag]
            tags.append(tag)
        return tags[::-1]


#: Elements whose presence on a page says something of what lies outside of them.
_BODIES = ("<article>", "<main>", "content", "article", "post", "entry", "story")


def outside_names(blocks: list[Block], names: dict[str, int]) -> int:
    mask, wanted = 0, sum(1 << names[n] for n in _BODIES if n in names)
    for b in blocks:
        mask |= b.element.held & wanted
    return mask


def fit(pages: list[tuple[list[Block], list[int]]], names: dict[str, int], rounds: int = 140, shrink: float = 0.0005) -> Field:
    """Gradient ascent (Adam) on the exact conditional log-likelihood of the pages' tags, weights drawn to 0."""
    by_bit = {at: name for name, at in names.items()}
    pages = sorted(pages, key=lambda p: -len(p[0]))  # so the pages that have a block number t are the first ones
    columns: dict[str, int] = {}
    rows = []
    for blocks, _ in pages:
        over = outside_names(blocks, names)
        for b, whole in zip(blocks, page_features(blocks)):
            near = b.element.own | (b.element.parent.own if b.element.parent else 0)
            found = ["all", *text_features(b), *whole]
            for kind, mask in (("in ", b.element.held), ("near ", near), ("outside ", over & ~b.element.held)):
                found += [kind + by_bit[i] for i in names_in(mask)]
            rows.append([columns.setdefault(f, len(columns)) for f in found])
    sizes = np.array([len(row) for row in rows])
    flat, row_starts = np.concatenate([np.array(row) for row in rows]), np.cumsum(sizes) - sizes
    of_columns = lambda values: np.bincount(flat, np.repeat(values, sizes), len(columns))
    lengths = np.array([len(t) for _, t in pages])
    n, longest = len(pages), int(lengths[0])
    place = np.concatenate([np.arange(k) + i * longest for i, k in enumerate(lengths)])  # of each row in the padded grid
    tags, same = np.zeros(n * longest, int), np.zeros(n * longest, int)
    tags[place] = np.concatenate([t for _, t in pages])
    same[place] = [int(i > 0 and b[i].element.parent is b[i - 1].element.parent) for b, _ in pages for i in range(len(b))]
    tags, same = tags.reshape(n, longest), same.reshape(n, longest)
    active = [int((lengths > t).sum()) for t in range(longest)]
    stepped = (np.arange(longest) < lengths[:, None])[:, 1:]
    each, hot = np.arange(n), np.eye(2)
    # what the labelled tags have
    real = {"w": of_columns(tags.reshape(-1)[place]), "s": np.zeros((2, 2, 2)), "e": np.array([hot[tags[:, 0]].sum(0), hot[tags[each, lengths - 1]].sum(0)])}
    np.add.at(real["s"], (same[:, 1:][stepped], tags[:, :-1][stepped], tags[:, 1:][stepped]), 1)
    p = {"w": np.zeros(len(columns)), "s": np.zeros((2, 2, 2)), "e": np.zeros((2, 2))}
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step in range(1, rounds + 1):
        score = np.zeros((n * longest, 2))
        score[place, 1] = np.add.reduceat(p["w"][flat], row_starts)
        score = score.reshape(n, longest, 2)
        steps = p["s"][same]
        forward, backward = np.zeros_like(score), np.zeros_like(score)
        forward[:, 0] = score[:, 0] + p["e"][0]
        for t in range(1, longest):
            k = active[t]
            through = forward[:k, t - 1, :, None] + steps[:k, t]
            forward[:k, t] = np.logaddexp(through[:, 0], through[:, 1]) + score[:k, t]
        backward[each, lengths - 1] = p["e"][1]
        for t in range(longest - 2, -1, -1):
            k = active[t + 1]
            through = steps[:k, t + 1] + (score[:k, t + 1] + backward[:k, t + 1])[:, None, :]
            backward[:k, t] = np.logaddexp(through[..., 0], through[..., 1])
        total = np.logaddexp(*(forward[each, lengths - 1] + p["e"][1]).T)[:, None, None]
        chance = np.exp(forward + backward - total)
        pair = np.exp(forward[:, :-1, :, None] + steps[:, 1:] + (score + backward)[:, 1:, None, :] - total[..., None])[stepped]
        kind = same[:, 1:][stepped]
        want = {"w": of_columns(chance[..., 1].reshape(-1)[place]), "s": np.array([pair[kind == i].sum(0) for i in (0, 1)]), "e": np.array([chance[:, 0].sum(0), chance[each, lengths - 1].sum(0)])}
        for k in p:
            slope = (real[k] - want[k]) / n - shrink * p[k]
            first[k] = 0.9 * first[k] + 0.1 * slope
            second[k] = 0.99 * second[k] + 0.01 * slope**2
            p[k] += 0.1 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return Field(names, {f: float(p["w"][i]) for f, i in columns.items()}, p["s"], p["e"])


# ---- labelled pages ------------------------------------------------------------------------------

#: Stands before the text of a block of main text in a labelled page.
MARK = "\ue000"

#: Words for classes and ids by what an element is for. Fixed values of the training pages.
CLASS_WORDS = {
    "content": ["content", "article", "post", "entry", "story", "text", "body-text", "main", "article-body", "post-content", "entry-content", "story-body", "page-content", "main-content", "blog-post", "news-text", "description", "hentry"],
    "nav": ["nav", "navbar", "menu", "main-menu", "navigation", "breadcrumb", "breadcrumbs", "topnav", "nav-links", "site-nav", "tabs", "pagination", "pager", "toc", "links", "skip-link", "categories", "tags"],
    "header": ["header", "site-header", "masthead", "topbar", "logo", "branding", "page-header", "top", "banner", "site-title"],
    "footer": ["footer", "site-footer", "page-footer", "copyright", "legal", "bottom", "colophon", "credits", "foot", "footer-links"],
    "sidebar": ["sidebar", "side", "aside", "widget", "widgets", "related", "related-posts", "rail", "recommended", "popular", "trending", "more-stories", "secondary", "teaser", "author-box", "sidebar-right"],
    "notice": ["notice", "cookie", "cookies", "cookie-banner", "consent", "gdpr", "alert", "message", "notification", "popup", "modal", "overlay", "warning", "announcement", "disclaimer", "paywall", "privacy-notice"],
    "advert": ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "banner-ad", "adsense", "ad-slot", "commercial", "partner", "ad-container", "adbox"],
    "form": ["form", "search", "search-form", "login", "signup", "subscribe", "newsletter", "contact-form", "subscription", "register", "poll", "survey"],
    "comments": ["comments", "comment", "comment-list", "commentlist", "responses", "replies", "disqus", "discussion", "reader-comments", "comment-body", "feedback", "reply", "user-comments", "comments-area"],
    "share": ["share", "social", "sharing", "social-links", "share-buttons", "follow", "addthis"],
}
_PLAIN_CLASSES = ["container", "wrap", "wrapper", "row", "col", "inner", "section", "box", "block", "clearfix", "grid", "layout", "page", "left", "right", "center", "holder", "group"]
_LABELS = {
    "nav": "Home|About us|Contact|News|Products|Blog|Skip to content|Next page|Previous|Site map|Menu".split("|"),
    "header": "The Daily Site|Welcome|Your trusted source|Search|Log in|My account|Register".split("|"),
    "footer": "© 2021 All rights reserved|Copyright 2019|Privacy policy|Terms of use|Contact us|Imprint|Powered by".split("|"),
    "sidebar": "Related stories|Most read|You may also like|Recent posts|Popular|Archive|About the author|Follow us".split("|"),
    "notice": "We use cookies to improve your experience.|Accept|Accept all cookies|Please enable JavaScript to view this page.|This site uses cookies. Read our privacy policy.|Subscribe to continue reading.|Close".split("|"),
    "advert": "Advertisement|Sponsored|Buy now|Limited offer|Shop today|Ad|Learn more|Order now and save".split("|"),
    "form": "Name|Email|Subscribe|Send|Search|Sign up for our newsletter|Your message|Password|Submit|I agree to the terms".split("|"),
    "comments": "3 Comments|Leave a reply|Reply|Report|Log in to comment|Anonymous says:|2 days ago|Like".split("|"),
    "share": "Share|Tweet|Facebook|Email this|Print|Follow us|Copy link".split("|"),
}


class Writer:
    """Invented pages; what is main text carries the mark."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        r = self.r
        kind = r.random()
        if kind < 0.8:
            w = "".join(r.choice("the an er in on re st nd ha or le da mo si ku va né ü ñ".split()) for _ in range(r.randint(1, 4)))
        elif kind < 0.9:
            w = "".join(chr(r.randint(0x430, 0x44F)) for _ in range(r.randint(2, 8)))
        elif kind < 0.95:
            w = "".join(chr(r.randint(0x4E00, 0x4FFF)) for _ in range(r.randint(2, 8)))
        else:
            w = r.choice(["2024", "17", "3.5", "|", "&amp;", "&quot;x&quot;", "AB", *sorted(NOTICE_WORDS)])
        return w

    def prose(self, least: int, most: int) -> str:
        n, out = self.r.randint(least, most), []
        start = True
        for _ in range(n):
            w = self.word()
            out.append((w[:1].upper() + w[1:] if start else w) + ("." if self.r.random() < 0.12 else "," if self.r.random() < 0.05 else ""))
            start = out[-1].endswith(".")
        return " ".join(out) + ("." if n > 3 or self.r.random() < 0.4 else "")

    def some(self) -> str:
        return self.prose(*self.r.choice([(1, 2), (3, 12), (10, 40), (30, 120)]))

    def attributes(self, kind: str | None, sure: bool = False) -> str:
        """A class or id of this kind, or none at all, or words that say nothing."""
        r = self.r
        words = [r.choice(CLASS_WORDS[kind])] if kind and (sure or r.random() < 0.8) else []
        if r.random() < 0.4:
            words.insert(r.randint(0, len(words)), r.choice(_PLAIN_CLASSES))
        if not words:
            return ""
        if r.random() < 0.2:
            words = ["-".join(words)]
        value = " ".join(words)
        return f' class="{value}"' if r.random() < 0.7 else f" id='{'-'.join(words)}'" if r.random() < 0.7 else f" class={words[-1]}"

    def link(self, text: str) -> str:
        return f'<a href="/{self.r.randint(1, 999)}">{text}</a>'

    def wrap(self, inner: str) -> str:
        for _ in range(self.r.choice([0, 0, 1, 2])):
            inner = f"<div{self.attributes(None)}>{inner}</div>"
        return inner

    def apart(self, kind: str) -> str:
        """A piece that is not main text."""
        r = self.r
        tag = {"nav": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form", "comments": "section"}.get(kind)
        semantic = tag and r.random() < 0.55
        label = lambda: r.choice(_LABELS[kind]) if r.random() < 0.5 else self.prose(1, 5)
        if kind == "nav" or kind == "share" or r.random() < 0.2:
            items = [self.link(label()) if r.random() < 0.95 else label() for _ in range(r.randint(2, 9))]
            inner = r.choice([lambda: "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", lambda: " ".join(items), lambda: " | ".join(items), lambda: "".join(f"<div>{x}</div>" for x in items)])()
        elif kind == "form":
            inner = "".join(r.choice([f"<label>{label()}</label><input type=text>", f"<p>{label()}</p>", f"<button>{label()}</button>", f"<div>{label()}</div>", f"<select><option>{label()}<option>{label()}</select>"]) for _ in range(r.randint(1, 5)))
        elif kind == "comments":
            one = lambda: r.choice([lambda: f"<p{self.attributes(None)}>{self.prose(1, 3)}</p><p>{self.some()}</p>", lambda: f"<b>{self.prose(1, 2)}</b> {self.some()}", lambda: f"<h4>{self.prose(1, 2)}</h4><p>{self.some()}</p><p>{self.some()}</p>{self.link('Reply')}"])()
            inner = r.choice(["", f"<h2>{label()}</h2>", f"<h3>{label()}</h3>", f"<p>{label()}</p>"]) + "".join(r.choice([f"<div{self.attributes('comments')}>{one()}</div>", f"<li{self.attributes('comments')}>{one()}</li>", f"<article{self.attributes('comments', True)}>{one()}</article>"]) for _ in range(r.randint(1, 5)))
            inner += self.apart("form") * (r.random() < 0.2)
        else:
            pieces = [lambda: f"<p>{label()}</p>", lambda: f"<div>{label()}</div>", lambda: f"<h3>{label()}</h3>", lambda: self.link(label()), lambda: f"<p>{self.some()}</p>", lambda: self.some(), lambda: "&copy; " + self.some() + " &middot; " + self.prose(2, 10) if kind == "footer" else label()]
            inner = "".join(r.choice(pieces)() for _ in range(r.choice([1, 1, 2, 4])))
        if semantic:
            named = self.attributes(kind, True) if kind == "comments" else self.attributes(kind) if r.random() < 0.4 else ""  # a section says nothing by itself
            return self.wrap(f"<{tag}{named}>{inner}</{tag}>")
        holder = r.choice(["div", "div", "div", "section", "ul" if inner.startswith("<li") else "p" if "<" not in inner else "div"])
        return self.wrap(f"<{holder}{self.attributes(kind, True)}>{inner}</{holder}>")

    def marked(self, text: str) -> str:
        return MARK + text

    def main_block(self) -> str:
        r, t = self.r, lambda *a: self.marked(self.prose(*a) if a else self.some())
        inline = lambda s: s.replace(" ", f" <{(k := r.choice(['b', 'i', 'em', 'span']))}>", 1) + f"</{k}>" if " " in s and r.random() < 0.3 else s
        return r.choice(
            [lambda: f"<p>{inline(t())}</p>"] * 9
            + [lambda: f"<p>{t()}", lambda: f"<p><b>{t()}<br>", lambda: f"<div>{t()}</div>", lambda: f"<h{(k := r.randint(2, 4))}>{t(1, 8)}</h{k}>", lambda: "<ul>" + "".join(f"<li>{inline(t(1, 20))}</li>" for _ in range(r.randint(1, 5))) + "</ul>",
               lambda: "<ol>" + "".join(f"<li>{t(2, 30)}" for _ in range(r.randint(1, 4))) + "</ol>", lambda: f"<blockquote><p>{t()}</p></blockquote>", lambda: f"<blockquote>{t()}</blockquote>", lambda: f"<pre>{t(5, 60)}</pre>",
               lambda: f"<figure><img src=x><figcaption>{t(2, 12)}</figcaption></figure>", lambda: "<table>" + "".join("<tr>" + "".join(f"<td>{t(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 3))) + "</table>",
               lambda: f"<p>{t(1, 1)}</p>", lambda: f"<p>{t(3, 20)} {self.link(self.prose(1, 4))} {self.prose(3, 20)}</p>", lambda: f"<section><h2>{t(1, 6)}</h2><p>{t()}</p></section>", lambda: f"<dl><dt>{t(1, 3)}</dt><dd>{t(4, 20)}</dd></dl>"]
        )()

    def page(self) -> str:
        r = self.r
        title = self.prose(2, 10)
        blocks = [self.main_block() for _ in range(r.choice([1, 3, 6, 12, 20]))]
        for _ in range(r.choice([0, 0, 1, 2])):
            blocks.insert(r.randint(0, len(blocks)), self.apart(r.choice(["advert", "advert", "share", "sidebar", "form", "notice", "nav"])))
        heading = r.choice([f"<h1>{self.marked(title)}</h1>"] * 4 + [f"<header><h1>{self.marked(title)}</h1></header>", f"<h2>{self.marked(title)}</h2>", ""])
        inner = heading + "".join(blocks) + (self.apart(r.choice(["comments", "comments", "share", "sidebar", "form", "footer"])) if r.random() < 0.25 else "")
        if r.random() < 0.15:
            inner = f"<div{self.attributes('content')}>{inner}</div>"
        tag = r.choice(["article", "article", "main", "div", "div", "section"])
        plain = tag in ("article", "main") and r.random() < 0.6
        body = f"<{tag}{'' if plain else self.attributes('content', tag in ('div', 'section') and r.random() < 0.85)}>{inner}</{tag}>"
        if tag == "article" and r.random() < 0.3:
            body = f"<main>{body}</main>"
        inside = "".join(self.apart(r.choice(["sidebar", "comments", "advert"])) for _ in range(r.choice([0, 0, 1])))
        body = self.wrap(body + inside)
        before = [k for k, chance in (("notice", 0.3), ("header", 0.5), ("nav", 0.8), ("advert", 0.5), ("form", 0.2), ("sidebar", 0.2), ("nav", 0.2), ("share", 0.1)) if r.random() < chance]
        after = [k for k, chance in (("share", 0.2), ("advert", 0.3), ("comments", 0.45), ("sidebar", 0.4), ("form", 0.2), ("footer", 0.85), ("notice", 0.3), ("advert", 0.1)) if r.random() < chance]
        if r.random() < 0.3:
            r.shuffle(after)
        head = f'<!DOCTYPE html><html lang="en"><head><title>{title}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body{self.attributes(r.choice(["sidebar", "content", None]))}>'
        return head + "".join(map(self.apart, before)) + body + "".join(map(self.apart, after)) + ("</body></html>" if r.random() < 0.9 else "")


def labelled(page: str, names: Names) -> tuple[list[Block], list[int]]:
    blocks = blocks_of(page, names)
    tags = [int(MARK in b.text) for b in blocks]
    for b in blocks:
        b.text = b.text.replace(MARK, "") or "."
        b.linked = min(b.linked, len(b.text))
    return blocks, tags


def invented_pages(n: int, seed: int) -> list[str]:
    return [Writer(seed * 100_003 + i).page() for i in range(n)]


#: Pages that the field is fitted on, and their seed.
PAGES, SEED = 1000, 11


@lru_cache(maxsize=2)
def trained(n: int = PAGES, seed: int = SEED) -> Field:
    names = Names()
    pages = [p for p in (labelled(page, names) for page in invented_pages(n, seed)) if p[0]]
    return fit(pages, names.known)


# ---- the operator --------------------------------------------------------------------------------


def main_text(page: str | None, field: Field, names: Names) -> str:
    blocks = blocks_of(page or "", names)
    return "\n".join(b.text for b, tag in zip(blocks, field.decode(blocks)) if tag)


EXTRACTED = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    field = field or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names(field.names)
        for batch in slices(batches, 128):
            texts = [main_text(page, field, names) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, EXTRACTED)


def op11_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(read_table(spark, sf_dir, "pages"))
