"""Leaf blocks of a page: runs of text between the bounds of block elements."""

from __future__ import annotations

import html as references
import re
import zlib
from collections import Counter
from dataclasses import dataclass

#: Hashed features of blocks lie below this.
WIDTH = 2**14
#: Elements of which no text is shown.
UNSEEN = frozenset("script style noscript template iframe svg canvas object math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that do not say what a part of a page is.
GENERIC = INLINE | frozenset("html body div p li ul ol dl dt dd table tbody thead tr td th h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption center label".split())
#: Elements whose start ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
#: Elements that end an open one of their own kind, and what hides it from them.
ENDS_OWN = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HIDES = frozenset("ul ol dl table select menu body html".split())
TAG = re.compile(r"""<([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
NAME = re.compile(r"[a-z]{2,}|[A-Z]{2,}(?![a-z])|[A-Z][a-z]+")
END = re.compile(r"</([A-Za-z][^\s/>]*)[^>]*(?:>|\Z)")
UNSEEN_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.IGNORECASE) for tag in UNSEEN}


@dataclass
class Block:
    """Text with one white space between words, the hashed features of all
    elements around it and (once more) of the nearest that says what it is, its
    nearest block element's tag, a number that names this element within the page,
    and how much of the text is linked."""

    text: str
    around: frozenset[int]
    near: frozenset[int]
    tag: str
    parent: int
    linked: float


def slot(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % WIDTH


class Reader:
    """Reads a page once from left to right; its work grows with its length."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self._open: list[tuple[str, frozenset[int], frozenset[int], int]] = [("", frozenset(), frozenset(), 0)]
        self._counts: Counter[str] = Counter()
        self._elements = 0
        self._pieces: list[str] = []
        self._linked = 0

    def read(self, page: str) -> list[Block]:
        at, end = 0, len(page)
        while at < end:
            low = page.find("<", at)
            self._text(page[at : end if low < 0 else low])
            if low < 0:
                break
            at = self._markup(page, low)
        self._flush()
        return self.blocks

    def _markup(self, page: str, low: int) -> int:
        """Takes what stands at the sign ``<``; returns where to read on."""
        following = page[low + 1 : low + 2]
        if page.startswith("<!--", low):
            return self._behind(page, "-->", low + 4)
        if following in ("!", "?"):
            return self._behind(page, ">", low + 1)
        if following == "/" and (found := END.match(page, low)):
            self._close(found[1].lower())
            return found.end()
        if following.isascii() and following.isalpha() and (found := TAG.match(page, low)):
            tag = found[1].lower()
            if tag in UNSEEN:
                if tag not in INLINE:
                    self._flush()
                if found[2].endswith("/"):
                    return found.end()
                last = UNSEEN_END[tag].search(page, found.end())
                return last.end() if last else len(page)
            self._start(tag, found[2])
            return found.end()
        self._text("<")
        return low + 1

    @staticmethod
    def _behind(page: str, mark: str, at: int) -> int:
        found = page.find(mark, at)
        return len(page) if found < 0 else found + len(mark)

    def _text(self, text: str) -> None:
        if text:
            text = references.unescape(text) if "&" in text else text
            self._pieces.append(text)
            self._linked += len(text.strip()) if self._counts["a"] else 0

    def _flush(self) -> None:
        text = " ".join("".join(self._pieces).split())
        if text:
            tag, around, near, element = next(x for x in reversed(self._open) if x[0] not in INLINE)
            self.blocks.append(Block(text, around, near, tag, element, min(1.0, self._linked / len(text))))
        self._pieces, self._linked = [], 0

    def _start(self, tag: str, attributes: str) -> None:
        if tag not in INLINE:
            self._flush()
        if tag in VOID:
            return
        if tag in ENDS_P and self._counts["p"]:
            self._close("p")
        for own in ENDS_OWN.get(tag, ()):
            self._close_own(own)
        names = {f"t:{tag}"}
        if "=" in attributes and tag not in INLINE:
            for kind, *values in ATTRIBUTE.findall(attributes):
                for word in NAME.findall("".join(values)):
                    names |= {f"{'r' if kind.lower() == 'role' else 'c'}:{word.lower()}", f"s:{word[:5].lower()}"}
        _, around, near, _ = self._open[-1]
        own = frozenset(map(slot, names)) if tag not in INLINE else frozenset()
        self._elements += 1
        if tag not in INLINE and (tag not in GENERIC or len(names) > 1):
            near = frozenset(slot(f"n{name}") for name in names)
        self._open.append((tag, around if own <= around else around | own, near, self._elements))
        self._counts[tag] += 1

    def _close_own(self, tag: str) -> None:
        """Ends an open element of this kind in the same list or table."""
        if self._counts[tag]:
            for name, *_ in reversed(self._open):
                if name == tag:
                    self._close(tag)
                    return
                if name in HIDES:
                    return

    def _close(self, tag: str) -> None:
        if tag in ("p", "br") and not self._counts[tag]:
            self._flush()
        if not self._counts[tag]:
            return
        if tag not in INLINE:
            self._flush()
        elif any(name not in INLINE for name, *_ in self._inner(tag)):
            return
        while True:
            name, *_ = self._open.pop()
            self._counts[name] -= 1
            if name == tag:
                return

    def _inner(self, tag: str):
        """Elements opened since the last open one of this kind."""
        for x in reversed(self._open):
            if x[0] == tag:
                return
            yield x
            if x[0] not in INLINE:
                return


def leaf_blocks(page: str | None) -> list[Block]:
    """Blocks of a page in order; a null page is empty."""
    return Reader().read(page or "")
