"""Elements of pages as a table function: one pass of a tolerant tokenizer a page, a row for each element."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.features import KEY, VOID

#: Elements whose content is text up to their own end tag.
RAW = ("script", "style")
#: Elements that end where one of these begins, as HTML lets their end tags be left out.
IMPLIED = {
    "li": "li", "dt": "dt dd", "dd": "dt dd", "option": "option optgroup", "optgroup": "optgroup", "td": "td th tr tbody thead tfoot", "th": "td th tr tbody thead tfoot", "tr": "tr tbody thead tfoot",
    "tbody": "tbody tfoot", "thead": "tbody tfoot", "p": "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul",
}
#: Elements that an implied end doesn't reach through, unless it ends them, too.
BARRIER = set("ul ol dl table select body html div section article td th button".split())

#: Which open elements end where an element begins.
ENDED = {name: [x for x in IMPLIED if name in IMPLIED[x].split()] for name in {y for x in IMPLIED.values() for y in x.split()}}

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)))?""")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}
_PROPERTY = re.compile(r"-{0,2}[A-Za-z][A-Za-z0-9-]*")

SCHEMA = "pos int, tag string, depth int, parent int, classes array<string>, style string, properties array<string>, role int, alt int, aria int, data int, body string"


def declared(css: str, depth: int) -> list[str]:
    """The distinct property names of a style text in order; ``depth`` 0 is a sheet, where only what is in braces declares
    (a selector's or a media feature's colon doesn't), 1 an inline style. A colon in a string or a bracket declares nothing."""
    out, part, quote, bracket, i = {}, [], "", 0, 0

    def take() -> None:
        name, colon, _ = "".join(part).partition(":")
        if depth > 0 and colon and _PROPERTY.fullmatch(name.strip()):
            out[name.strip().lower()] = None
        part.clear()

    while i < len(css):
        c = css[i]
        if quote:
            i += c == "\\"
            quote = "" if c == quote else quote
        elif css.startswith("/*", i):
            end = css.find("*/", i + 2)
            i = len(css) if end < 0 else end + 1
        elif c in "\"'":
            quote = c
        elif c in "()":
            bracket = max(0, bracket + (1 if c == "(" else -1))
        elif c == "{" and not bracket:
            part.clear()
            depth += 1
        elif c in ";}" and not bracket:
            take()
            depth -= c == "}" and depth > 0
        else:
            part.append(c)
        i += 1
    take()
    return list(out)


def tokens(html: str) -> Iterator[tuple]:
    """``("open", name, attributes, closed, body)`` and ``("close", name)`` in order.

    Comments, declarations and instructions give nothing; one without its end reaches to the end of the text, as a raw
    text element does. ``<`` before anything but a letter, ``/``, ``!`` or ``?`` is text.
    """
    at = 0
    while (at := html.find("<", at)) >= 0:
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            at = len(html) if end < 0 else end + 3
        elif html.startswith(("<!", "<?"), at):
            end = html.find(">", at)
            at = len(html) if end < 0 else end + 1
        elif html.startswith("</", at) and (m := _NAME.match(html, at + 2)):
            end = html.find(">", m.end())
            at = len(html) if end < 0 else end + 1
            yield "close", m[0].lower()
        elif m := _NAME.match(html, at + 1):
            name, attributes, at = m[0].lower(), [], m.end()
            while (m := _ATTRIBUTE.match(html, at)) and m.end() > at:
                attributes.append((m[1].lower(), unescape(next((x for x in m.groups()[1:] if x is not None), ""))))
                at = m.end()
            end = html.find(">", at)
            if end < 0:  # a tag that never ends is none
                return
            closed, at, body = html[end - 1] == "/", end + 1, None
            if name in RAW and not closed:
                m = _RAW_END[name].search(html, at)
                stop = m.start() if m else len(html)
                body, at = html[at:stop], stop
            yield "open", name, attributes, closed, body
        else:
            at += 1


def elements(html: str | None) -> Iterator[tuple]:
    """The rows of ``SCHEMA`` of one page; a null or empty page has none.

    ``depth`` counts open tags as they are written: each one adds a level that any end tag takes away, void elements aside.
    ``parent`` is the ``pos`` of the element that holds this one where left-out end tags are filled in; an end tag
    without its start changes nothing there, and one further out closes all in it.
    """
    depth, pos, stack, places, barriers = 0, 0, [], {}, []  # places: by name, where in the stack; barriers: where they are

    def cut(k: int) -> None:
        while len(stack) > k:
            _, name = stack.pop()
            places[name].pop()
            if name in BARRIER:
                barriers.pop()

    for token in tokens(html or ""):
        name = token[1]
        if token[0] == "close":
            depth -= name not in VOID and depth > 0
            if places.get(name):
                cut(places[name][-1])
            continue
        _, _, attributes, closed, body = token
        if ended := ENDED.get(name):
            wall = next((k for k in reversed(barriers) if stack[k][1] not in ended), -1)
            cut(min((at[i] for x in ended if (at := places.get(x)) and (i := bisect_right(at, wall)) < len(at)), default=len(stack)))
        values = {}
        for key, value in attributes:  # the first of equal attributes counts
            values.setdefault(key, value)
        style = values.get("style") or None
        inline = declared(style, 1) if style else []
        yield (
            pos, name, depth + 1, stack[-1][0] if stack else None, (values.get("class") or "").split(), style, declared(body, 0) if name == "style" and body else inline,
            int("role" in values), int("alt" in values), sum(x.startswith("aria-") for x in values), sum(x.startswith("data-") for x in values), body,
        )
        if name not in VOID and not closed:
            depth += 1
            places.setdefault(name, []).append(len(stack))
            if name in BARRIER:
                barriers.append(len(stack))
            stack.append((pos, name))
        pos += 1


@F.udtf(returnType=SCHEMA)
class Elements:
    def eval(self, html: str) -> Iterator[tuple]:
        yield from elements(html)


def page_elements(cards: DataFrame) -> DataFrame:
    """The elements of each card. Cards without elements have no row."""
    return cards.select(*KEY, "html").lateralJoin(Elements(F.col("html").outer())).drop("html")


def collected(rows: DataFrame) -> DataFrame:
    """What each card declares, counted: a row for each card that has elements."""
    total = lambda c, name: F.sum(c).cast("long").alias(name)
    size = lambda tag: F.when(F.col("tag") == tag, F.length("body")).otherwise(0)
    return rows.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("tag").alias("n_tags"), F.max("depth").cast("long").alias("max_depth"), total("depth", "sum_depth"), total(F.size("classes"), "n_classes"),
        F.count("style").alias("n_inline"), *[total(c, f"n_{c}") for c in ("role", "alt", "aria", "data")], total(size("style"), "style_chars"), total(size("script"), "script_chars"),
    )


def feature_rows(rows: DataFrame, api: str) -> DataFrame:
    """Distinct ``token`` rows of tags, classes, declared properties (in sheets and inline) and the words of scripts that the
    pattern ``api`` knows."""
    of = lambda kind, items: rows.select(*KEY, F.explode(items).alias("x")).select(*KEY, F.concat(F.lit(f"{kind}:"), "x").alias("token"))
    words = F.when(F.col("tag") == "script", F.regexp_extract_all("body", F.lit(api), F.lit(1)))
    return of("tag", F.array("tag")).union(of("class", F.col("classes"))).union(of("css", F.col("properties"))).union(of("jsapi", words)).distinct()
