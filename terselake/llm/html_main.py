"""Main text of a web page by line-block distribution.

Markup is stripped into lines, one per block. Lines in elements that are furniture by name or by their
class, id or role count as empty. Characters inside ``article`` or ``main`` weigh ``WEIGHT`` times, and what
counts as empty between two lines inside is no dive; a line on the other side of their border follows a dive.
The length summed over ``WINDOW`` neighbouring lines rises at the main text and falls to nothing after it:
a surge is a sum above a threshold relative to the page's largest, a dive an empty line, and the text
between the two is kept whole, short lines too. Runs that hold little against the largest are dropped.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
SURGE = 86
SHARE = 0.2
WEIGHT = 2

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style".split())
INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CELLS = frozenset(("td", "th"))
FURNITURE = frozenset(
    "script style noscript template svg iframe object canvas head title nav footer aside form select button textarea menu dialog".split()
)
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising adbox adsense sponsor sponsored promo promotion banner menu nav navbar "
    "navigation breadcrumb breadcrumbs sidebar footer masthead topbar notice notices cookie cookies consent gdpr newsletter "
    "subscribe signup login share sharing social related recommended recommendations comment comments disqus reply replies "
    "respond popup modal overlay widget toolbar pagination pager copyright search".split()
)
#: Parts of names that say nothing of what an element holds.
PLAIN = frozenset(
    "area aside bar block box button buttons card cards center col column container content div form frame group header icon icons inner item items "
    "left link links list main more note outer panel posts right row section site small text the title top bottom wrap wrapper".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
KEPT = frozenset("html body main article".split())

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)/?>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_PARTS = re.compile(r"[^a-z0-9]+")


def _is_furniture(name: str, attributes: str, inside: bool) -> bool:
    if name in FURNITURE or name == "header" and not inside:
        return True
    if not attributes or name in ("html", "body", "main"):
        return False
    for kind, *values in _ATTRIBUTE.findall(attributes):
        value = next((v for v in values if v), "").lower()
        if kind.lower() == "role":
            if value in ROLES:
                return True
        elif any(_names_furniture(token, inside) for token in value.split()):
            return True
    return False


def _names_furniture(token: str, inside: bool) -> bool:
    """Whether a class or id names furniture. Inside an article all its parts have to: ``related-work`` is text there."""
    parts = {p for p in _PARTS.split(token) if p}
    if inside:
        return bool(parts & HINTS) and all(p in HINTS or p in PLAIN or p.isdigit() for p in parts)
    return bool(parts & HINTS) or "header" in parts


def lines(page: str) -> list[tuple[str, bool, bool]]:
    """(text, furniture, inside an article) of each block in page order; empty texts mark container borders."""
    out: list[tuple[str, bool, bool]] = []
    held: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, furniture, inside
    furniture = inside = False

    def end(border: bool = False):
        text = " ".join(entities.unescape("".join(held)).split())
        held.clear()
        if text:
            out.append((text, furniture, inside))
        if border:
            out.append(("", furniture, inside))

    at, last = 0, page.rfind(">")
    while at < len(page):
        m = _MARKUP.search(page, at) if at <= last else None
        if not m:
            held.append(page[at:])
            break
        held.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if closing:
            if name not in INLINE:
                if name in CELLS:
                    held.append(" ")
                else:
                    end(name in KEPT)
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    changed = any(x[1] for x in stack[k:])
                    del stack[k:]
                    if changed:
                        end(True)
                    furniture, inside = (stack[-1][1], stack[-1][2]) if stack else (False, False)
                    break
            continue
        mine = _is_furniture(name, attributes, inside)
        if name not in INLINE or mine:
            if name in CELLS:
                held.append(" ")
            else:
                end(mine and not furniture or name in ("article", "main"))
        if name in RAW:
            close = re.compile(f"</{name}", re.I).search(page, at)
            at = close.start() if close else len(page)
            if close:
                at = page.find(">", at) + 1 or len(page)
            continue
        if name in VOID or attributes.endswith("/"):
            continue
        if name == "p" and stack and stack[-1][0] == "p":
            stack.pop()
        furniture, inside = furniture or mine, inside or name in ("article", "main")
        stack.append((name, furniture, inside))
    end()
    return out


def main_text(page: str | None) -> str:
    """Kept blocks joined by a line feed; empty for a null, empty or all-furniture page."""
    found = lines(page or "")
    rows: list[tuple[str, int]] = []  # text and weighed length; a length of 0 is a dive
    last, was = -1, False
    for k, (text, furniture, inside) in enumerate(found):
        if text and not furniture:
            if not (inside and was):
                rows += [("", 0)] * max(k - last - 1, inside != was)
            rows.append((text, len(text) * (WEIGHT if inside else 1)))
            last, was = k, inside
    size = [n for _, n in rows]
    window = [sum(size[max(0, i - WINDOW + 1) : i + WINDOW]) for i in range(len(size))]
    surge = min(SURGE, max(window, default=0) / 3)
    runs, start = [], None
    for i, n in enumerate([*size, 0]):
        if n and start is None:
            start = i
        elif not n and start is not None:
            if max(window[start:i]) > surge:
                runs.append((start, i, sum(size[start:i])))
            start = None
    most = max((n for _, _, n in runs), default=0)
    return "\n".join(rows[k][0] for a, b, n in runs if n >= SHARE * most for k in range(a, b))


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """All columns and rows of ``pages`` as struct ``page``, and ``text``, the main text of ``column``.

    A null or empty page has an empty text; pages of any length are read whole; repeated rows are read
    each; names can't clash, as the input row stays a struct. An empty table gives no rows.
    """
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns if c != column]).alias("page"), F.col(column).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([main_text(x.as_py()) for x in b.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), texts], ["page", "text"])

    return rows.mapInArrow(run, f"page {rows.schema['page'].dataType.simpleString()}, text string")
