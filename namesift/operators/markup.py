"""Links and titles of pages by element and attribute, read by a small state machine.

Attributes may stand in any order, in single, double or no quotes, and in any case. What only looks like
an element, inside comments, scripts, styles or text fields, is not one. Any text is read in one pass, in time
that grows with its length.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements whose content is text whatever it looks like.
RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript")
LINK_COLUMNS = ["id", "pos", "href", "text"]
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_KEY = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}


@dataclass(frozen=True)
class Selector:
    """An element by its name, by classes it must all have, and by values of attributes; ``None`` means the attribute is there."""

    element: str = "a"
    classes: frozenset[str] = frozenset()
    attributes: Mapping[str, str | None] = field(default_factory=dict)

    def fits(self, name: str, attributes: Mapping[str, str]) -> bool:
        if name != self.element or not self.classes <= set(attributes.get("class", "").split()):
            return False
        return all(key in attributes and value in (None, attributes[key]) for key, value in self.attributes.items())


def _attributes(page: str, at: int) -> tuple[dict[str, str], int]:
    """Attributes of a tag whose name ends at ``at``, and the place behind the tag; the first of equal names counts."""
    found: dict[str, str] = {}
    while (key := _KEY.match(page, at)) is not None:
        at, value = key.end(), ""
        if (equals := _EQUALS.match(page, at)) is not None:
            at = equals.end()
            quote = page[at : at + 1]
            if quote in ("'", '"') and quote:
                end = page.find(quote, at + 1)
                end = len(page) if end < 0 else end
                value, at = page[at + 1 : end], end + 1
            else:
                bare = _BARE.match(page, at)
                value, at = bare.group(), bare.end()
        found.setdefault(key.group(1).lower(), html.unescape(value))
    end = page.find(">", at)
    return found, len(page) if end < 0 else end + 1


def parts(page: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """``(kind, name or text, attributes)`` in page order: ``text``, ``start``, ``end``; raw elements' content is ``raw``."""
    at, n = 0, len(page)
    while at < n:
        open_at = page.find("<", at)
        if open_at < 0:
            yield "text", page[at:], {}
            return
        if open_at > at:
            yield "text", page[at:open_at], {}
        at = open_at
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = n if end < 0 else end + 3
            continue
        closing = page.startswith("/", at + 1)
        name = _NAME.match(page, at + 1 + closing)
        if name is None:
            if page[at + 1 : at + 2] in ("!", "?", "/") and at + 1 < n:
                end = page.find(">", at)
                at = n if end < 0 else end + 1
            else:
                yield "text", "<", {}
                at += 1
            continue
        attributes, at = _attributes(page, name.end())
        lower = name.group().lower()
        yield ("end" if closing else "start"), lower, attributes
        if not closing and lower in _RAW_END:
            end = _RAW_END[lower].search(page, at)
            stop = end.start() if end else n
            yield "raw", page[at:stop], {}
            at = stop


def elements(page: str | None, selector: Selector, n: int | None = None) -> list[tuple[dict[str, str], str]]:
    """Attributes and text of the first ``n`` elements that fit, in page order.

    An element's text ends where the next element of that name begins or ends, as links do not nest; its white
    space is made one space and character references are decoded.
    """
    out: list[tuple[dict[str, str], str]] = []
    kept: tuple[dict[str, str], list[str]] | None = None

    def close() -> None:
        nonlocal kept
        if kept is not None:
            out.append((kept[0], " ".join(html.unescape("".join(kept[1])).split())))
            kept = None

    for kind, value, attributes in parts(page or ""):
        if kind == "text" and kept is not None:
            kept[1].append(value)
        elif kind == "raw" and kept is not None and selector.element in RAW:
            kept[1].append(value)
        elif kind in ("start", "end") and value == selector.element:
            close()
            if n is not None and len(out) >= n:
                return out
            if kind == "start" and selector.fits(value, attributes):
                kept = (attributes, [])
    close()
    return out[:n]


def _select(selector: Selector, n: int | None, attribute: str, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [
            (key, pos, found.get(attribute), text)
            for key, page in zip(batch["id"], batch["html"], strict=True)
            for pos, (found, text) in enumerate(elements(page, selector, n))
        ]
        yield pd.DataFrame(rows, columns=LINK_COLUMNS)


def select_elements(
    pages: DataFrame,
    selector: Selector,
    n: int | None = None,
    attribute: str = "href",
    id_col: str = "page_id",
    html_col: str = "html",
) -> DataFrame:
    """``id, pos, <attribute>, text`` of the first ``n`` fitting elements of every page; a page without any gives no row.

    A null page has none. An element without the attribute gives a NULL there. One pass, no shuffle.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).filter("html is not null")
    key = rows.schema["id"].dataType.simpleString()
    found = rows.mapInPandas(functools.partial(_select, selector, n, attribute), f"id {key}, pos int, href string, text string")
    return found.withColumnRenamed("href", attribute)


def links_by_class(pages: DataFrame, class_name: str, n: int, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``id, pos, href, text`` of the first ``n`` links of one class per page."""
    return select_elements(pages, Selector("a", frozenset([class_name]), {"href": None}), n, "href", id_col, html_col)


def page_titles(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``id, title``: text of the first title element of every page, however it is written; empty without one."""
    found = select_elements(pages, Selector("title"), 1, "lang", id_col, html_col).select(F.col("id"), F.col("text").alias("title"))
    ids = pages.select(F.col(id_col).alias("id")).distinct()
    return ids.join(found, "id", "left").select("id", F.coalesce("title", F.lit("")).alias("title"))
