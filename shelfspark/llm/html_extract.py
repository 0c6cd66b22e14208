"""Main text of web pages by composite text density.

Every block element gets its characters per tag, adjusted for the share of link text. The element whose
children's densities have the largest sum is the heart of the page; the least density on the path from the
body to it is the threshold. Elements from the body down that reach the threshold give their best subtree.
Page furniture (navigation, headers, forms, adverts, comments) carries no text at all; an inline element may be
furniture too. A name only marks an element as furniture: a wrapper that holds the page's main element, or without
one its longest article, is none, and neither is a layout wrapper ("layout-sidebar-left") with most of the page's text.

The logarithms of the density are shifted by one, so pages without links are defined. Inline elements count
as tags of their block, not as elements to choose.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices

# --- fixed values: elements by role, names of page furniture ---------------------------------
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small "
                   "span strike strong sub sup time tt u var br wbr".split())
RAW = frozenset("script style noscript template iframe textarea svg canvas object title".split())
FURNITURE = frozenset("head nav header footer aside form button select menu dialog".split()) | RAW
FURNITURE_NAMES = frozenset(
    "ad ads advert advertisement adverts adverbox banner sidebar menu navbar nav navigation breadcrumb breadcrumbs footer header "
    "masthead cookie cookies consent notice notices notification alert popup modal promo promoted sponsor sponsored newsletter "
    "subscribe comment comments disqus reply replies share sharing social related recommended widget login search".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
NEVER_FURNITURE = frozenset(("html", "body", "main"))
COMMENT_NAMES = frozenset("comment comments disqus reply replies".split())
LAYOUT_NAMES = frozenset("sidebar nav navbar menu widget search login".split())
MODIFIERS = frozenset("has with no without".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav "
                     "ol p pre section table ul".split())
CLOSES_OWN = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"),
              "td": ("tr",), "th": ("tr",), "option": ("select",)}

_TOKEN = re.compile(r"<!--|<![^>]*+>|<\?[^>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
                    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?", re.I)
_NAME = re.compile(r"[a-z0-9]+")

# How surely an element is furniture: a layout wrapper may hold the text, a named one the main element, the rest is gone.
LIVE, LAYOUT, NAMED, GONE = range(4)


def furniture(tag: str, attributes: str) -> int:
    if tag in FURNITURE:
        return GONE
    if tag in NEVER_FURNITURE or not attributes:
        return LIVE
    sure = LIVE
    for match in _ATTRIBUTE.finditer(attributes):
        name, value = match.group(1).lower(), (match.group(2) or match.group(3) or match.group(4) or "").lower()
        if name in ("class", "id"):
            tokens = value.split()
            if COMMENT_NAMES.intersection(tokens):
                return GONE
            if tag == "article":
                continue
            for token in tokens:
                parts = _NAME.findall(token)
                named = FURNITURE_NAMES.intersection(parts)
                if named and (len(parts) == 1 or parts[0] not in MODIFIERS):
                    sure = max(sure, LAYOUT if len(parts) > 1 and named <= LAYOUT_NAMES else NAMED)
        elif tag == "article" and name == "role":
            continue
        elif name == "role" and value.strip() in FURNITURE_ROLES:
            return GONE
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            return GONE
    return sure


class Page:
    """Block elements in page order, each with its parent; pieces of text with the element they stand in."""

    def __init__(self, source: str):
        self.tag, self.parent, self.sure, self.gone = ["#page"], [-1], [LIVE], [False]
        self.tags, self.links, self.link_chars, self.chars = [0], [0], [0], [0]
        self.pieces: list[tuple[int, int, str]] = []  # (element, number of the block, text)
        self.stack, self.open = [0], Counter()
        self._read(source)
        self.dead = self._dead()

    def _push(self, tag: str, sure: int) -> None:
        here = self.stack[-1]
        self.tag.append(tag)
        self.parent.append(here)
        self.sure.append(sure)
        self.gone.append(self.gone[here] or sure == GONE)
        for counts in (self.tags, self.links, self.link_chars, self.chars):
            counts.append(0)
        self.stack.append(len(self.tag) - 1)
        self.open[tag] += 1

    def _pop(self, depth: int) -> None:
        """End the elements from this depth of the stack on."""
        for k in self.stack[depth:]:
            self.open[self.tag[k]] -= 1
        del self.stack[depth:]

    def _depth_of(self, tag: str) -> int:
        """Depth of the innermost open element of a tag, 0 if there is none."""
        if not self.open[tag]:
            return 0
        return next(d for d in range(len(self.stack) - 1, 0, -1) if self.tag[self.stack[d]] == tag)

    def _text(self, source: str, block: int, in_link: bool) -> None:
        at = self.stack[-1]
        if self.gone[at]:
            return
        text = entities.unescape(source)
        self.pieces.append((at, block, text))
        n = len("".join(text.split()))
        self.chars[at] += n
        self.link_chars[at] += n * in_link

    def _read(self, source: str) -> None:
        stack, block, in_link, at = self.stack, 0, 0, 0
        while at < len(source):
            less = source.find("<", at)
            if less < 0:
                self._text(source[at:], block, in_link > 0)
                break
            match = _TOKEN.match(source, less)
            end = match.end() if match else less + 1
            if less > at or not match:
                self._text(source[at:less] if match else source[at:end], block, in_link > 0)
            at = end
            if not match:
                continue
            if match.group() == "<!--":
                close = source.find("-->", at)
                at = len(source) if close < 0 else close + 3
                continue
            slash, tag, attributes = (match.group(1), match.group(2), match.group(3)) if match.group(2) else match.groups()[3:]
            if not tag:
                continue
            tag = tag.lower()
            if slash:
                depth = self._depth_of(tag)
                if depth:
                    self._pop(depth)
                elif tag == "a":
                    in_link = max(0, in_link - 1)
                block += tag not in INLINE
                continue
            here, sure = stack[-1], furniture(tag, attributes)
            if tag in RAW and not attributes.endswith("/"):
                close = re.compile(rf"</{tag}\b[^>]*+>?", re.I).search(source, at)
                at = close.end() if close else len(source)
                block += tag not in INLINE
                continue
            if tag in INLINE:
                # Inline furniture is an element until its end, as are equal tags inside it, so that this end is found.
                if tag not in VOID and (sure or self.open[tag]):
                    self._push(tag, sure)
                    continue
                self.tags[here] += 1
                if tag == "a":
                    self.links[here] += 1
                    in_link += 1
                if tag == "br":
                    self.pieces.append((here, block, " "))
                continue
            block += 1
            if tag in VOID:
                self.tags[here] += 1
                continue
            if tag in CLOSES_P:
                depth = len(stack) - 1
                while depth and self.tag[stack[depth]] in INLINE:
                    depth -= 1
                if self.tag[stack[depth]] == "p":
                    self._pop(depth)
            if tag in CLOSES_OWN and (self.open[tag] or self.open["dt"] or self.open["dd"]):
                for depth in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[depth]] in CLOSES_OWN[tag]:
                        break
                    if self.tag[stack[depth]] == tag or (tag in ("dt", "dd") and self.tag[stack[depth]] in ("dt", "dd")):
                        self._pop(depth)
                        break
            self._push(tag, sure)
            in_link = in_link if not self.gone[stack[-1]] else 0

    def _dead(self) -> list[bool]:
        """Furniture, by element, once the whole page is known."""
        n = len(self.tag)
        chars, link_chars = list(self.chars), list(self.link_chars)
        for k in range(n - 1, 0, -1):
            chars[self.parent[k]] += chars[k]
            link_chars[self.parent[k]] += link_chars[k]
        texts = [k for k in range(n) if self.tag[k] in ("main", "article") and chars[k]]
        heart = max([k for k in texts if self.tag[k] == "main"] or texts, key=lambda k: (chars[k], -k), default=-1)
        holders, k = set(), heart
        while k >= 0:
            holders.add(k)
            k = self.parent[k]
        dead = [False] * n
        for k in range(1, n):
            most = self.sure[k] == LAYOUT and heart < 0 and 2 * chars[k] > chars[0] and 2 * link_chars[k] < chars[k]
            excused = self.sure[k] < GONE and (k in holders or most)
            dead[k] = dead[self.parent[k]] or (self.sure[k] > LIVE and not excused)
        return dead

    def text(self) -> str:
        """Blocks of the chosen subtrees in page order."""
        n = len(self.tag)
        tags, links = [t + 1 for t in self.tags], list(self.links)
        chars, link_chars = list(self.chars), list(self.link_chars)
        for k in range(n - 1, 0, -1):
            if not self.dead[k]:
                p = self.parent[k]
                tags[p] += tags[k]
                links[p] += links[k]
                chars[p] += chars[k]
                link_chars[p] += link_chars[k]
        body = next((k for k in range(n) if self.tag[k] == "body"), 0)
        share = link_chars[body] / max(1, chars[body])
        density, total, inner = [0.0] * n, [0.0] * n, [False] * n
        for k in range(n - 1, -1, -1):
            c, lc = chars[k], link_chars[k]
            if c and not self.dead[k]:
                base = log(1 + log(c / max(1, c - lc) * lc + share * c + e))
                density[k] = c / tags[k] * log(1 + c / max(1, lc) * tags[k] / max(1, links[k])) / base
            if not inner[k]:
                total[k] = density[k]
            if k and density[k]:
                p = self.parent[k]
                total[p] += density[k]
                inner[p] = True
        alive = [k for k in range(n) if density[k] and (k == body or self._under(k, body))]
        if not alive:
            return ""
        heart = max(alive, key=lambda k: (total[k], k))
        threshold, k = density[heart], heart
        while k != body:
            k = self.parent[k]
            threshold = min(threshold, density[k])
        # The best subtree of each element that reaches the threshold; alive is in page order.
        best = {k: k for k in alive}
        for k in reversed(alive):
            p = self.parent[k]
            if p in best and total[best[k]] > total[best[p]]:
                best[p] = best[k]
        taken = [False] * n
        for k in alive:
            if density[k] >= threshold and (k != body or best[k] == body):
                taken[best[k]] = True
        for k in range(1, n):
            taken[k] = taken[k] or (taken[self.parent[k]] and not self.dead[k])
        blocks: dict[int, list[str]] = {}
        for at, block, text in self.pieces:
            if taken[at] and not self.dead[at]:
                blocks.setdefault(block, []).append(text)
        lines = (" ".join("".join(parts).split()) for parts in blocks.values())
        return "\n".join(line for line in lines if line)

    def _under(self, k: int, top: int) -> bool:
        return top == 0 or k > top


def main_text(source: str | None) -> str:
    return Page(source).text() if source else ""


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row, from the whole html.

    Null, empty and textless pages give an empty text. Broken markup is read as far as it goes: unclosed elements
    end with their parent, an unclosed comment or script ends the page. Repeated and null ids are rows of their own.
    """
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h) for h in batch.column("html").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"])

    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                          F.col("html").cast("string").alias("html"))
    return map_slices(narrow, "html", work, "page_id long, url string, text string, n_chars long")
