"""Main text of web pages by wrappers: union-free regular expressions inferred from the token streams of each host's pages.

A page becomes a stream of structure tags and text slots. Streams of one host are aligned one after the other: what only one of them
has becomes an optional group, a group that follows itself becomes a repeated one, and differing texts become slots. The slots of a
host's wrapper are then judged once for the host, by the containers they lie in and by what all pages of the host put into them, and
every page returns the text of its main slots.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.session import pinned

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"[\s ]+")

RAW = frozenset("script style textarea title noscript template iframe svg math xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var label".split())
#: Elements whose open paragraph or item an opening tag of the same kind ends.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
DROPPED = frozenset("head nav footer aside form button select option input fieldset object canvas dialog menu audio video map".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class, id and role that mark what is not the article, and those that mark it.
NOT_MAIN = frozenset(
    "ad ads adv advert adverts advertisement advertising banner promo promoted sponsor sponsored cookie cookies consent gdpr notice notices alert popup modal overlay nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar aside complementary widget footer contentinfo masthead topbar toolbar share sharing social related recommended comment comments reply replies respond disqus "
    "discussion form login signup subscribe newsletter search pagination pager skip dialog disclaimer".split()
)
#: Of these, the ones that an article element itself may bear.
NOT_ARTICLE = frozenset("ad ads advert advertisement promo promoted sponsored related recommended comment comments reply replies".split())
MAIN = frozenset("article main content post entry story articlebody body text".split())


def _marks(tag: str, attributes: str) -> tuple[str, bool, bool, bool]:
    """(label for the stream, not main, main, header) of an opening tag."""
    words, hidden = set(), False
    for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("hidden", "aria-hidden"):
            hidden |= name == "hidden" or value.lower() == "true"
        else:
            words |= set(_WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()))
    header = tag == "header" or "header" in words
    main = tag in ("article", "main") or bool(words & MAIN) and tag not in ("body", "html")
    marked = words & (NOT_ARTICLE if tag in ("article", "main") else NOT_MAIN)
    dropped = tag in DROPPED or hidden or bool(marked) and tag not in ("body", "html")
    return tag + "".join("." + w for w in sorted(words & (NOT_MAIN | MAIN | {"header"}))), dropped, main and not dropped, header


def blocks_of(page: str | None) -> list[tuple[str, str, int, str]]:
    """(path, text, characters in links, sort) of the text blocks of a whole page, in order. Sort: 'a' inside an article or main
    element, 'm' inside another main container, 'x' in one that is not main, 'o' elsewhere. Null pages have none."""
    page = page or ""
    stack: list[tuple[str, str, bool, bool, bool]] = []
    out, buffer, links, in_link, at = [], [], 0, 0, 0

    def flush() -> None:
        nonlocal links
        text = _SPACE.sub(" ", entities.unescape("".join(buffer))).strip(" ")
        if text:
            dropped = any(s[2] for s in stack)
            inside = [i for i, s in enumerate(stack) if s[3]]
            header = any(s[4] and not (inside and i > inside[0] and stack[-1][0] in HEADINGS) for i, s in enumerate(stack))
            out.append(("/".join(s[1] for s in stack) or "#", text, min(links, len(text)), "x" if dropped or header else "a" if any(stack[i][0] in ("article", "main") for i in inside) else "m" if inside else "o"))
        buffer.clear()
        links = 0

    def words(text: str) -> None:
        nonlocal links
        buffer.append(text)
        if in_link:
            links += len(text)

    while True:
        m = _TAG.search(page, at)
        if m is None:
            words(page[at:])
            break
        words(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in INLINE or tag in ("br", "wbr", "img"):
            if tag == "a":
                in_link = max(0, in_link + (-1 if closing else 1))
            elif tag == "br":
                buffer.append(" ")
            continue
        if tag in RAW and not closing:
            end = re.compile(rf"</{tag}\b[^>]*+>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        flush()
        in_link = 0
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        while stack and (stack[-1][0] == "p" or stack[-1][0] in HEADINGS and tag in HEADINGS or stack[-1][0] in CLOSES.get(tag, ())):
            stack.pop()
        if tag == "body":
            stack[:] = [s for s in stack if s[0] == "html"]
        if tag not in VOID:
            stack.append((tag, *_marks(tag, m[3])))
    flush()
    return out


# A wrapper is a list of nodes: "path" (a text slot), or ("+", nodes) or ("?", nodes).


def _bare(node):
    return node[1][0] if isinstance(node, tuple) and node[0] == "+" and len(node[1]) == 1 else node


def folded(nodes: list, longest: int = 6) -> list:
    """Groups that follow themselves become repeated groups; short groups first."""
    for n in range(1, longest + 1):
        out: list = []
        for node in nodes:
            out.append(node)
            while True:
                group, before = out[-n:], out[-2 * n : -n]
                if len(before) == n and [_bare(x) for x in group] == [_bare(x) for x in before]:
                    out[-2 * n :] = [("+", group)] if n > 1 else [("+", [_bare(group[0])])]
                elif len(out) > n and out[-n - 1] == ("+", group):
                    del out[-n:]
                else:
                    break
        nodes = out
    return nodes


def _key(node) -> str:
    node = _bare(node)
    return node if isinstance(node, str) else repr(_key_list(node[1]))


def _key_list(nodes: list) -> list[str]:
    return [_key(x) for x in nodes]


def aligned(wrapper: list, other: list) -> list:
    """The wrapper that also accepts ``other``: equal nodes stay (repeated if either is), what only one side has becomes optional."""
    plain = [x[1] if isinstance(x, tuple) and x[0] == "?" else [x] for x in wrapper]
    keys, theirs = ["\0".join(_key_list(x)) for x in plain], _key_list(other)
    out: list = []
    for op, a1, a2, b1, b2 in SequenceMatcher(None, keys, theirs, autojunk=False).get_opcodes():
        if op == "equal":
            out += [_wider(w, o) for w, o in zip(wrapper[a1:a2], other[b1:b2])]
            continue
        out += [x if isinstance(x, tuple) and x[0] == "?" else ("?", [x]) for x in wrapper[a1:a2]]
        if b2 > b1:
            out.append(("?", list(other[b1:b2]))) if b2 - b1 == 1 else out.extend(("?", [x]) for x in other[b1:b2])
    return out


def _wider(a, b):
    if isinstance(a, tuple) and a[0] == "?":
        return ("?", [_wider(a[1][0], b)]) if len(a[1]) == 1 else a
    return b if isinstance(b, tuple) and b[0] == "+" and not isinstance(a, tuple) else a


def slots(wrapper: list) -> list[str]:
    out: list[str] = []
    for node in wrapper:
        out += [node] if isinstance(node, str) else slots(node[1])
    return list(dict.fromkeys(out))


def text_of(wrapper: list) -> str:
    return " ".join(n if isinstance(n, str) else f"({text_of(n[1])}){n[0]}" for n in wrapper)


def parsed(text: str) -> list:
    """The inverse of :func:`text_of`; paths hold no spaces or brackets."""
    stack: list[list] = [[]]
    for token in re.findall(r"\(|\)[+?]|[^\s()]+", text):
        if token == "(":
            stack.append([])
        elif token[0] == ")":
            group = stack.pop()
            stack[-1].append((token[1], group))
        else:
            stack[-1].append(token)
    return stack[0]


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def page_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, ...) -> (page_id, url, host, stream, blocks)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [blocks_of(h) for h in pdf["html"]]
            streams = [text_of(folded([b[0] for b in x])) for x in found]
            yield pd.DataFrame({"page_id": pdf["page_id"].astype("Int64"), "url": pdf["url"], "host": pdf["host"], "stream": streams, "blocks": [[dict(zip(("path", "text", "links", "sort"), b)) for b in x] for x in found]})

    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    return rows.mapInPandas(run, "page_id long, url string, host string, stream string, blocks array<struct<path:string,text:string,links:int,sort:string>>")


def wrappers(streams: DataFrame, salts: int = 16) -> DataFrame:
    """(host, stream) -> (host, wrapper). Equal streams count once; a host's different streams are aligned in ``salts`` parts, whose
    wrappers are aligned with each other. The longest streams come first, ties by their text, so reruns agree."""

    def infer(pdf: pd.DataFrame) -> pd.DataFrame:
        wrapper: list | None = None
        for stream in sorted(pdf["stream"], key=lambda s: (-len(s), s)):
            other = parsed(stream)
            wrapper = other if wrapper is None else folded(aligned(wrapper, [x[1][0] if isinstance(x, tuple) and x[0] == "?" and len(x[1]) == 1 else x for x in other]))
        return pd.DataFrame({"host": pdf["host"][:1], "stream": [text_of(wrapper or [])]})

    shape = "host string, stream string"
    different = streams.select("host", "stream").distinct().withColumn("salt", F.pmod(F.xxhash64("stream"), F.lit(salts)))
    parts = different.groupBy("host", "salt").applyInPandas(lambda pdf: infer(pdf), shape)
    return parts.groupBy("host").applyInPandas(infer, shape).withColumnRenamed("stream", "wrapper")


def main_slots(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """(host, article, main, other): slots of the host's wrapper inside article elements, inside other main containers, and those that
    hold the article where a page has neither: outside of menus and the like, mostly not links, and not the same few words on all
    pages. Pages count once however many copies of them there are, and so does a text in a slot of a page."""
    slot = F.udf(lambda w: slots(parsed(w or "")), "array<string>")
    listed = found.select("host", F.explode(slot("wrapper")).alias("path"))
    page = F.xxhash64(F.filter("blocks", lambda b: b["sort"] == "o"))
    each = blocks.select("host", page.alias("page"), F.explode("blocks").alias("b"))
    judged_by = [F.when(F.col("b.sort") == "o", c).alias(k) for k, c in (("page", F.col("page")), ("h", F.xxhash64("b.text")), ("n", F.length("b.text")), ("links", F.col("b.links")))]
    each = each.select("host", F.col("b.path").alias("path"), F.col("b.sort").alias("sort"), *judged_by).distinct()
    texts = each.groupBy("host", "path", "h").agg(F.min("sort").alias("sort"), F.count("*").alias("c"), F.sum("n").alias("n"), F.sum("links").alias("links"))
    facts = texts.groupBy("host", "path").agg(F.min("sort").alias("sort"), *[F.sum(c).alias(c) for c in ("c", "n", "links")], F.count("h").alias("different"))
    same = (F.col("c") >= 5) & (F.col("different") * 10 <= F.col("c")) & (F.col("n") < F.col("c") * 200)
    other = (F.col("sort") == "o") & (F.col("links") * 3 < F.col("n")) & ~same
    judged = listed.join(facts, ["host", "path"]).withColumn("kind", F.when(F.col("sort") == "a", "article").when(F.col("sort") == "m", "main").when(other, "other"))
    return judged.groupBy("host").agg(*[F.collect_set(F.when(F.col("kind") == k, F.col("path"))).alias(k) for k in ("article", "main", "other")])


def _of(blocks: str, slots_: str, sort: str) -> Column:
    return F.filter(blocks, lambda b: F.array_contains(slots_, b["path"]) & (b["sort"] == sort))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, ...) -> (page_id, url, text, n_chars, host).

    Null or empty pages have an empty text. Pages without a host in their url share the empty host. Repeated rows come back as often as
    they came; an empty table gives an empty one. A line break inside a block counts as white space.
    """
    rows = pinned(page_blocks(pages))
    keep = pinned(main_slots(rows, pinned(wrappers(rows))))
    joined = rows.join(keep, "host", "left")
    article, main, other = (_of("blocks", k, k[0]) for k in ("article", "main", "other"))
    chosen = F.when(F.size(article) > 0, article).when(F.size(main) > 0, main).otherwise(other)
    text = F.coalesce(F.array_join(F.transform(chosen, lambda b: b["text"]), "\n"), F.lit(""))
    return joined.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"), "host")
