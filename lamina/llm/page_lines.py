"""Text lines of a web page: one line per block, with what the markup says about it.

A small scanner walks through tags and text. White space inside a block becomes one space and character
references are decoded. Lines of scripts, styles, forms, menus and other elements that HTML keeps apart
from the main text are left out, and so are elements whose class, id or role names page furniture.
"""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

# a comment, a declaration, a tag cut off at the end of the page, a tag
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?=/?[a-zA-Z])[^>]*\Z|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)>", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?(?=[\s/]|\Z)", re.S | re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# Names of HTML elements by what they do to the text.
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody tfoot thead tr ul".split())
APART = frozenset("nav footer aside form head template svg math canvas object audio video select button dialog menu search datalist map".split())
ENDS_P = BLOCKS - frozenset("body head html option caption legend summary tbody tfoot thead tr".split())
# Words by which pages name furniture, and words that negate them.
FURNITURE = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs masthead topbar header footer sidebar aside widget widgets ad ads advert adverts advertisement adslot sponsor "
    "sponsored promo promotion banner cookie cookies consent gdpr notice alert alertdialog popup modal overlay newsletter subscribe subscription signup login paywall "
    "search share sharing social related recommended recommendations comment comments disqus reply replies respond copyright pagination pager contentinfo complementary "
    "dialog form toolbar skip".split())
NEGATIONS = frozenset("has no with without".split())
COMMENTS = frozenset("comment comments disqus reply replies respond".split())


class Line(NamedTuple):
    text: str
    inside: bool  # lies in an article or main element


def _names(attributes: str) -> tuple[frozenset[str], bool]:
    """Furniture words in class, id and role; whether the element is hidden."""
    words, hidden = set(), False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            hidden = True
        elif name in ("class", "id", "role"):
            for label in value.split():
                parts = [p.lower() for p in _TOKEN.findall(label)]
                words.update(p for k, p in enumerate(parts) if p in FURNITURE and not (k and parts[k - 1] in NEGATIONS))
    return frozenset(words), hidden


def page_lines(html: str | None) -> list[Line]:
    """Lines of a page in order; those inside an article (else a main element) only, when there are any.

    Names of classes, ids and roles are not heeded where nothing would be left.
    """
    return _lines(html or "", True) or _lines(html or "", False)


def _lines(html: str, by_name: bool) -> list[Line]:
    lines: list[tuple[str, bool, bool]] = []
    parts: list[str] = []
    open_: list[tuple[str, str]] = []  # element and why it matters: apart, comment, article, main or nothing
    apart = articles = mains = headings = at = 0

    def flush() -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            parts.clear()
            if text:
                lines.append((text, articles > 0 or mains > 0 and headings > 0, mains > 0))

    def close(depth: int) -> None:
        nonlocal apart, articles, mains, headings
        for name, why in open_[depth:]:
            headings -= name == "h1"
            apart -= why in ("apart", "comment")
            articles -= why == "article"
            mains -= why == "main"
        del open_[depth:]

    while at < len(html):
        found = _MARKUP.search(html, at)
        if not apart:
            parts.append(html[at:found.start() if found else len(html)])
        if not found:
            break
        at = found.end()
        name = (found.group(2) or "").lower()
        if not name:
            continue
        if name in BLOCKS:
            flush()
        elif name in ("br", "td", "th") and not apart:
            parts.append(" ")
        if found.group(1):
            for depth in range(len(open_) - 1, -1, -1):
                if open_[depth][0] == name:
                    close(depth)
                    break
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        attributes = found.group(3) or ""
        if name in VOID or attributes.endswith("/") and name in ("svg", "path", "use"):
            continue
        words, hidden = _names(attributes) if by_name and attributes.strip(" /") else (frozenset(), False)
        if name in ENDS_P:
            for depth in range(len(open_) - 1, -1, -1):
                if open_[depth][0] in BLOCKS:
                    if open_[depth][0] == "p":
                        close(depth)
                    break
        why = ""
        if name in ("main", "article") and not words & COMMENTS:
            # furniture holds no main text: what it lies in was left open or is named by its layout only
            if apart and not any(w == "comment" or n in ("template", "aside", "svg") for n, w in open_ if w in ("apart", "comment")):
                open_[:] = [(n, "" if w == "apart" else w) for n, w in open_]
                apart = 0
            why = name
        elif words & COMMENTS:
            why = "comment"
        elif hidden or name in APART or name == "header" and not articles and not mains:
            why = "apart"
        elif words - ({"header"} if articles or mains else set()) and name not in ("html", "body", "header", "h1", "h2", "h3", "h4", "h5", "h6"):
            why = "apart"
        articles += why == "article"
        mains += why == "main"
        apart += why in ("apart", "comment")
        headings += name == "h1"
        open_.append((name, why))
    if not apart:
        flush()
    for place in (1, 2):
        if any(line[place] for line in lines):
            return [Line(line[0], True) for line in lines if line[place]]
    return [Line(line[0], False) for line in lines]
